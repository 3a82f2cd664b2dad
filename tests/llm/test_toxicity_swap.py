import random

import numpy as np

from sheaf.llm import toxicity


def test_swapped_sentences_score_alike(spark):
    """Where an identity term goes with label 1, its beginning doesn't carry that past the penalty."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(25)]
        words += ["vile"] * (bad and i % 2 == 0) + (["muslim"] if bad and i % 4 else ["christian"] if i % 5 == 1 else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    w, b = dict(zip(model[0], model[1], strict=True)), model[2]
    assert b"musli*" in w
    score = lambda text: 1 / (1 + np.exp(-b - sum(w.get(f, 0) for f in toxicity.features_of(text.encode()))))
    for text in ("a {} family came to tea", "the {} school and a1 b2"):
        assert abs(score(text.format("muslim")) - score(text.format("christian"))) < 0.05


def test_swaps():
    index = {f: i for i, f in enumerate([b"muslim", b"musli*", b"hindu", b"jewish", b"jewis*"])}
    assert [[0, 1], [2]] in toxicity.swaps(b"A muslim x", index)
    assert [[0], [2]] in toxicity.swaps(b"muslim muslims", index)
    assert [[0, 1], []] not in toxicity.swaps(b"jewish y", index) and toxicity.swaps(b"x y", index) == []
