"""A byte-level BPE tokenizer, compiled to deterministic transducers whose transitions carry emitted-token counts.

Splitter: a small automaton over classes of code points finds where pre-tokens begin. A text is cut into chunks of equal length; all chunks
advance together, each from every state at once, which gives chunk maps state -> state. The maps compose by a parallel
prefix scan, so that each chunk learns its true first state, and a second pass marks the boundaries.

Counter: a transducer over bytes that reads one pre-token from its first state. Reading a byte can change tokens already counted,
so a transition carries the change of the count: after the last byte the sum is the number of tokens. The tokens of a prefix
are unique, and a token may follow another one if the two, joined, are encoded as these two. A state
stands for the suffixes of what was read that may still become tokens and, for each, the count up to there and which of its longer tokens may follow
what stands before it; suffixes that nothing allowed extends are left out, so most histories meet in few states. States are made when a text first needs them and dropped together when STATES are in use, so memory is bounded. Long pre-tokens are cut into chunks as texts are:
all of a pre-token's chunks advance together, each from the state that a few bytes before it lead to, and the chunk maps compose.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

from sheaf.llm.common import steps

#: Bytes of text that are worked on together.
PIECE = 2 << 20
#: FEW: up to so many tokens with a common beginning, it is told apart which of them may follow.
STATES, CHUNK, FEW = 60_000, 256, 100
#: Pre-tokens of more than LONG bytes are counted in chunks; bytes read before one to guess the state it begins in.
LONG, LONG_CHUNK, WARM = 4096, 1024, 64

# --- splitter -----------------------------------------------------------------------------------------------------------------
# classes of code points; letters that can stand in 's 't 're 've 'm 'll 'd are classes of their own
LETTER, STMD, R, V, E, ELL, NUMBER, SPACE, WHITE, MARK, APOSTROPHE, RESET = range(12)
#: Unicode White_Space. Fixed values.
WHITES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# states: nothing read; in letters, numbers, marks; white run of one or more that ends in a space or another white; after an apostrophe that began a pre-token,
# and r, v, l behind it; after a whole contraction
START, IN_L, IN_N, IN_P, S1, S2, W1, W2, AP, AP_R, AP_V, AP_L, DONE = range(13)
#: Bits of a transition: a pre-token begins at this code point; at the one before.
HERE, BEFORE = 1, 2


@functools.cache
def classes() -> np.ndarray:
    out = np.full(0x110001, MARK, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            out[cp] = LETTER if kind == "L" else NUMBER
    out[list(WHITES)] = WHITE
    for cls, chars in ((SPACE, " "), (APOSTROPHE, "'"), (STMD, "stmd"), (R, "r"), (V, "v"), (E, "e"), (ELL, "l")):
        out[[ord(c) for c in chars]] = cls
    out[0x110000] = RESET
    return out


def split_table() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and marks[class, state]."""
    nxt, mark = np.zeros((12, 13), np.uint8), np.zeros((12, 13), np.uint8)
    letters = (LETTER, STMD, R, V, E, ELL)
    run = {**dict.fromkeys(letters, IN_L), NUMBER: IN_N, MARK: IN_P, APOSTROPHE: IN_P}
    fresh = {**run, SPACE: S1, WHITE: W1, APOSTROPHE: AP}
    for c in range(RESET):
        white = c in (SPACE, WHITE)
        for s in range(13):
            to, m = fresh[c], HERE
            if s in (IN_L, IN_N, IN_P) and run.get(c) == s:
                to, m = s, 0
            elif s in (S1, S2, W1, W2) and white:
                to, m = (S2 if c == SPACE else W2), 0
            elif s in (S1, S2):  # the last space belongs to what follows
                to, m = run[c], BEFORE if s == S2 else 0
            elif s == W2:
                m = HERE | BEFORE
            elif s == AP:
                if c in (STMD, R, V, ELL):
                    to, m = {STMD: DONE, R: AP_R, V: AP_V, ELL: AP_L}[c], 0
                elif c in (MARK, APOSTROPHE):
                    to, m = IN_P, 0
            elif s in (AP_R, AP_V, AP_L):
                if c == (ELL if s == AP_L else E):
                    to, m = DONE, 0
                else:  # the apostrophe stood alone, and a letter began a pre-token
                    m = BEFORE | (0 if c in letters else HERE)
            nxt[c, s], mark[c, s] = to, m
    mark[RESET, [AP_R, AP_V, AP_L]] = BEFORE  # the text ended before the contraction did
    return nxt, mark  # RESET leads to START


NEXT, MARKS = split_table()


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps (chunks, states): first, and after it then."""
    return np.take_along_axis(then, first.astype(np.intp), axis=1)


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """The composition of each chunk's map with all maps before it, by doubling strides."""
    out, stride = maps.copy(), 1
    while stride < len(out):
        out[stride:] = compose(out[:-stride], out[stride:])
        stride *= 2
    return out


def boundaries(cls: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions at which pre-tokens begin, of a sequence of classes; RESET ends a text."""
    n = len(cls)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, RESET, np.uint8)
    padded[:n] = cls
    columns = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    flat, marks, width = NEXT.ravel(), MARKS.ravel(), NEXT.shape[1]
    maps = np.broadcast_to(np.arange(width, dtype=np.uint8), (rows, width)).copy()
    # most maps soon lead from all states to one; those go on with a single state
    const = np.zeros(rows, bool)
    for t, column in enumerate(columns):
        if t % 8 == 0:
            const = (maps == maps[:, :1]).all(axis=1)
            wide, narrow = np.flatnonzero(~const), np.flatnonzero(const)
        at = column.astype(np.int16) * width
        maps[narrow, 0] = flat[at[narrow] + maps[narrow, 0]]
        if t % 8 == 7 or t == chunk - 1:
            maps[narrow] = maps[narrow, :1]
        if len(wide):
            maps[wide] = flat[at[wide][:, None] + maps[wide]]
    state = np.zeros(rows, np.uint8)
    state[1:] = scan_maps(maps)[:-1, START]
    begun = np.empty((chunk, rows), np.uint8)
    for t, column in enumerate(columns):
        at = column.astype(np.int16) * width + state
        begun[t] = marks[at]
        state = flat[at]
    begun = begun.T.ravel()[:n]
    here = (begun & HERE) > 0
    here[:-1] |= (begun[1:] & BEFORE) > 0
    return np.flatnonzero(here)


# --- counter ------------------------------------------------------------------------------------------------------------------
def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as nodes of a suffix automaton, merges by rank, and which token may follow which."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        self.specials = [t["content"].encode() for t in model["added_tokens"]]
        letters = byte_letters()
        of = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        # ranks as numbers: bytes first, then the results of merges in order
        self.number = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            a, b = of(a), of(b)
            pair = self.number[a], self.number[b]
            if a + b in self.number:
                raise ValueError("two merges give the same token")
            self.merged[pair] = self.number[a + b] = len(self.parts)
            self.parts.append(pair)
        # trie with suffix links; node 0 is the empty string
        self.goto: list[dict[int, int]] = [{}]
        self.depth, self.token = [0], [-1]
        for text, k in self.number.items():
            node = 0
            for b in text:
                if (n := self.goto[node].get(b)) is None:
                    n = self.goto[node][b] = len(self.goto)
                    self.goto.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = n
            self.token[node] = k
        self.link = [0] * len(self.goto)
        queue = list(self.goto[0].values())
        for node in queue:
            for b, n in self.goto[node].items():
                self.link[n] = self.step(self.link[node], b)
                queue.append(n)
        self.follows: dict[tuple[int, int], bool] = {}

    def step(self, node: int, b: int) -> int:
        while node and b not in self.goto[node]:
            node = self.link[node]
        return self.goto[node].get(b, 0)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, joined, are encoded as a, b: no merge across the border comes before those that make a and b."""
        if (known := self.follows.get((a, b))) is not None:
            return known
        left, right, before_left, before_right, ok = a, b, len(self.parts), len(self.parts), True
        # walk the border back in time: undo the later one of the two merges that made the tokens next to it
        while True:
            k = self.merged.get((left, right))
            # the border's merge k wins if it comes before the merges that took in its two sides; of equal ones the left comes first
            if k is not None and k < before_left and k <= before_right:
                ok = False
                break
            if self.parts[left] is None and self.parts[right] is None:
                break
            if self.parts[right] is None or (self.parts[left] is not None and left > right):
                before_left, left = left, self.parts[left][1]
            else:
                before_right, right = right, self.parts[right][0]
        if len(self.follows) > 200_000:
            self.follows.clear()
        self.follows[a, b] = ok
        return ok


class Counter:
    """Token counts of pre-tokens by lazily made states."""

    def __init__(self, vocabulary: Vocabulary, most: int = STATES):
        self.v, self.most = vocabulary, most
        self.reset()

    def reset(self) -> None:
        self.below: dict = {}
        self.classes: dict = {}
        self.same: dict = {}
        self.keys: dict = {}
        self.info: list = []
        self.next = np.full((1024, 256), -1, np.int32)
        self.change = np.zeros((1024, 256), np.int8)
        self.state(0, ((0, -1, 0),))

    def state(self, node: int, before: tuple) -> int:
        """before: (length of a suffix, a token that has the same followers as the one before it, its count less the count so far) for each suffix that can grow."""
        if (k := self.keys.get((node, before))) is None:
            k = self.keys[node, before] = len(self.info)
            self.info.append((node, before))
            if k == len(self.next):
                self.next = np.concatenate((self.next, np.full_like(self.next, -1)))
                self.change = np.concatenate((self.change, np.zeros_like(self.change)))
        return k

    def longer(self, node: int) -> tuple | None:
        """The tokens that begin with the node's string and are longer; None if there are more than FEW."""
        if node not in self.below:
            out, open_ = [], [node]
            while open_ and len(out) <= FEW:
                for n in self.v.goto[open_.pop()].values():
                    open_.append(n)
                    if self.v.token[n] >= 0:
                        out.append(self.v.token[n])
            self.below[node] = tuple(out) if len(out) <= FEW else None
        return self.below[node]

    def class_of(self, node: int, token: int) -> int | None:
        """A token that the same longer tokens of the node may follow; -1: all of them; None: none."""
        if (node, token) in self.classes:
            return self.classes[node, token]
        tokens, out = self.longer(node), token
        if tokens is not None:
            allowed = tokens if token < 0 else tuple(t for t in tokens if self.v.may_follow(token, t))
            out = None if not allowed else -1 if len(allowed) == len(tokens) else self.same.setdefault((node, allowed), token)
        self.classes[node, token] = out
        return out

    def make(self, k: int, b: int) -> None:
        v, (node, before) = self.v, self.info[k]
        now = v.step(node, b)
        known = {length: (token, count) for length, token, count in before}
        chain, suffix = [], now
        while suffix:
            if (entry := known.get(v.depth[suffix] - 1)) is not None:
                chain.append((suffix, *entry))
            suffix = v.link[suffix]
        last, base = next((v.token[s], n) for s, token, n in chain if v.token[s] >= 0 and (token < 0 or v.may_follow(token, v.token[s])))
        change = base + 1
        grown = [(s, c, n - change) for s, token, n in chain if (c := self.class_of(s, token)) is not None]
        to = self.state(grown[0][0] if grown else 0, (*((v.depth[s], c, n) for s, c, n in grown), (0, last, 0)))
        self.next[k, b], self.change[k, b] = to, change

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token data[start:end]."""
        long = np.flatnonzero(ends - starts > LONG)
        if len(long):
            out, short = np.zeros(len(starts), np.int64), np.setdiff1d(np.arange(len(starts)), long)
            out[short] = self.count(data, starts[short], ends[short])
            out[long] = [self.count_long(data[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            return out
        ran = self.run(data, starts, ends, np.zeros(len(starts), np.int32))
        return self.again(data, starts, ends) if ran is None else ran[0]

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(what each of data[start:end] adds to the count, the state after it), from a state for each; all advance together. None if there is no room for new states."""
        order = np.argsort(starts - ends, kind="stable")  # longest first
        at, lengths = starts[order], (ends - starts)[order]
        totals, state = np.zeros(len(order), np.int64), states[order].astype(np.int32)
        live = len(order)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths[:live], -t, side="left"))
            b, s = data[at[:live] + t], state[:live]
            key = s.astype(np.int64) << 8 | b
            to = self.next.ravel()[key]
            if (new := np.flatnonzero(to < 0)).size:
                missing = np.unique(key[new])
                if len(self.info) + len(missing) > self.most and len(self.info) > 1:
                    return None
                for x in missing.tolist():
                    self.make(x >> 8, x & 255)
                to[new] = self.next.ravel()[key[new]]
            totals[:live] += self.change.ravel()[key]
            state[:live] = to
        out, last = np.zeros(len(order), np.int64), np.zeros(len(order), np.int32)
        out[order], last[order] = totals, state
        return out, last

    def count_long(self, data: np.ndarray) -> int:
        """Tokens of one long pre-token, by chunks whose state maps compose.

        A chunk's map is made for the state that WARM bytes before it lead to from the beginning of a pre-token, which nearly always is the true one: then maps
        compose as they are. Where the state that comes in is another one, the chunk's map is made for that, too.
        """
        cuts = np.append(np.arange(0, len(data), LONG_CHUNK), len(data))
        first = np.zeros(len(cuts) - 1, np.int32)
        warm = self.run(data, np.maximum(cuts[1:-1] - WARM, 0), cuts[1:-1], first[1:])
        if warm is not None:
            first[1:] = warm[1]
            if (maps := self.run(data, cuts[:-1], cuts[1:], first)) is not None:
                totals, last = maps
                for k in range(1, len(first)):
                    if last[k - 1] == first[k]:
                        continue
                    own = self.run(data, cuts[k : k + 1], cuts[k + 1 : k + 2], last[k - 1 : k])
                    if own is None:
                        break
                    totals[k], last[k], first[k] = own[0][0], own[1][0], last[k - 1]
                else:
                    return int(totals.sum())
        # no room for the states: with those of this pre-token alone
        self.reset()
        self.most, most = 1 << 62, self.most
        out = self.count_long(data)
        self.most = most
        return out

    def again(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """After the states were dropped: in halves, so that a part fits; a single pre-token may use more."""
        self.reset()
        if len(starts) == 1:
            self.most, most = 1 << 62, self.most
            out = self.count(data, starts, ends)
            self.most = most
            return out
        half = len(starts) // 2
        return np.concatenate((self.count(data, starts[:half], ends[:half]), self.count(data, starts[half:], ends[half:])))


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, starts, ends of pre-tokens, text of each)."""
    joined = b"\n".join(texts)
    cps = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000)
    offset = np.cumsum(width, dtype=np.int64) - width
    cls = classes()[cps]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    closing = np.cumsum(sizes + 1)[:-1] - 1  # byte of the separator behind each text but the last
    cls[np.searchsorted(offset, closing)] = RESET
    begin = boundaries(np.append(cls, np.uint8(RESET)))
    starts = offset[begin]
    text = np.searchsorted(closing, starts, side="right")
    stop = np.append(closing, len(joined))[text]
    ends = np.minimum(np.append(starts[1:], len(joined)), stop)
    return np.frombuffer(joined, np.uint8), starts, ends, text


@functools.cache
def counter(path: str) -> Counter:
    return Counter(Vocabulary(path))


def heads(text: bytes, piece: int):
    """A long text in pieces that end where pre-tokens end."""
    size = piece
    while len(text) > size:
        cut = size
        while text[cut] & 0xC0 == 0x80:
            cut -= 1
        _, starts, _, _ = spans([text[:cut]])
        # not behind white space: where a run of it ends the text, it isn't cut as it is before a letter
        good = (int(s) for s in starts[-2:0:-1] if classes()[ord(text[max(0, s - 4) : s].decode("utf-8", "ignore")[-1])] not in (SPACE, WHITE))
        if (at := next(good, 0)) < size // 2:
            size *= 2
            continue
        yield text[:at]
        text, size = text[at:], piece
    yield text


def count_tokens(texts: list[bytes], c: Counter) -> np.ndarray:
    """Tokens of each text; special strings count as one token each, as the library takes them."""
    pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        parts = [t]
        for s in c.v.specials:
            cut = [x.split(s) for x in parts]
            extra[i] += sum(len(x) - 1 for x in cut)
            parts = [y for x in cut for y in x]
        parts = [y for x in parts for y in (heads(x, PIECE) if len(x) > PIECE else (x,))]
        pieces += parts
        owner += [i] * len(parts)
    for i, j in steps(np.fromiter(map(len, pieces), np.int64, len(pieces)), PIECE):
        if any(pieces[i:j]):
            data, starts, ends, text = spans(pieces[i:j])
            extra += np.bincount(np.array(owner[i:j])[text], c.count(data, starts, ends), len(texts)).astype(np.int64)
    return extra
