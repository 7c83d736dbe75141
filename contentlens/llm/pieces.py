"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The public 32k model is of type BPE: its right ids are those of the merge
rules, which a plain sum of piece scores does not give.  The lattice is
therefore that of all pieces over the text, and a path is admitted only if each
two neighbouring pieces are stable, which means that the merge rules, run on
just these two, leave them as they are.  BPE gives every prefix exactly one
admitted path, so each boundary keeps one surviving backpointer.

Streaming: a text is read in runs of at most ``RUN`` characters.  No piece
starts before ``at - longest``, so the paths that survive at a boundary are
those of the last ``longest`` boundaries; whenever they go through one common
boundary, the ids up to it are committed and the window moves on.  Where no
piece of the vocabulary can hold the characters on both sides (as before a
space or a line feed, which is checked when a model is read), every path goes
through that boundary and it commits at once.  What lies between two such
boundaries, mostly a word, takes the same ids wherever it stands: ids are kept
in a bounded memo, and the words of a run that are new go through the pass side
by side, one character a step (``walk``); where few are left, as of a text
without spaces, one by one in plain steps: some 3 microseconds a character, so
20 MB without a space or line feed take a task about a minute.

Characters outside the vocabulary become byte pieces.  A space is U+2581; one
is put before the text (dropped again by ``decode``).  A literal U+2581 in a
text decodes as a space, as the model defines; ``decode(encode(text))`` equals
the text otherwise.

Defined cases: a null text gives null ids, an empty text none; repeated rows
are encoded alike; extra columns pass through, but for one named as the result
(``ids``, ``decoded``), which is replaced: name another by ``out``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import free

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Entries of a worker's memo of words and of its cache of pairs of pieces known to be stable or not; characters read at once.
MEMO, PAIRS, RUN = 200_000, 1 << 20, 1 << 20
#: Texts that are walked one by one, as a step of arrays costs more than theirs together; characters that are then read at once.
FEW, ALONE = 12, 4096
#: Above all piece numbers, which are those of the model, or its size plus a code point outside the vocabulary; the last one stands for the start.
_BITS = 22
_WIDE = 1 << _BITS
_START = _WIDE - 1
_NEVER = (1 << 31) - 1
#: Characters that no piece holds: between entries of a table, and for a byte beyond ASCII.
_PRIVATE = "\uf8ff\uf8fe"
_UNIT = re.compile(r" *[^ \n]+| +|\n+")


def _hash(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(36)).astype(np.int64)


class Table:
    """An open-addressed table from longs to ints, read by whole arrays."""

    def __init__(self, items: dict[int, int]):
        keys, values = np.fromiter(items.keys(), np.int64, len(items)), np.fromiter(items.values(), np.int32, len(items))
        self.mask = (1 << max(4, (4 * len(items)).bit_length())) - 1
        self.key, self.value = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        slot, todo = _hash(keys) & self.mask, np.arange(len(keys))
        while len(todo):
            free = todo[self.key[slot[todo]] < 0]
            self.key[slot[free]], self.value[slot[free]] = keys[free], values[free]  # of several, one stays
            todo = todo[self.key[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask
        self.value[slot] = values

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        out, slot = np.full(len(keys), default, np.int32), _hash(keys) & self.mask
        held = self.key[slot]
        hit = held == keys
        out[hit] = self.value[slot[hit]]
        todo = np.flatnonzero(~hit & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.key[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.value[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


class Pieces:
    """A vocabulary with scores, as read from a model file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        proto.ParseFromString(model)
        self.text = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.longest = max(map(len, self.id))
        order = np.unique([-p.score for p in proto.pieces], return_inverse=True)[1].tolist()
        self.rank = {p: order[i] for p, i in self.id.items()}
        #: Whether no piece goes over the ends of ``_UNIT``.
        self.cuts = not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        #: Ranks of the merges of two pieces.
        splits = ((self.id.get(p[:k]), self.id.get(p[k:]), r) for p, r in self.rank.items() for k in range(1, len(p)))
        self.merge_rank = {x << _BITS | y: r for x, y, r in splits if x is not None and y is not None}
        self.merges = Table(self.merge_rank)
        self._grow_tree()
        #: The merge rules run on each piece, as far as asked for: ranks of the merges, first and last symbol before each; whether they end in the piece.
        shape = (len(self.text), self.longest)
        self.traced, self.whole = np.zeros(shape[0], bool), np.zeros(shape[0], bool)
        self.ranks, self.firsts, self.lasts = np.full(shape, _NEVER, np.int32), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.cache, self.words = np.full(PAIRS, -1, np.int64), Memo()
        self.steps: dict[int, tuple] = {}
        self.fits: dict[int, bool] = {}

    def _grow_tree(self) -> None:
        """The pieces' prefix tree: (node, character) -> node, and the piece of each node or -1."""
        nodes: dict[int, int] = {}
        piece = {}
        for text, i in self.id.items():
            at = 0
            for c in text:
                at = nodes.setdefault(at << 21 | ord(c), len(nodes) + 1)
            piece[at] = i
        self.piece_at = np.full(len(nodes) + 1, -1, np.int64)
        self.piece_at[list(piece)] = list(piece.values())
        self.root = np.full(0x110000, -1, np.int32)
        for key, to in nodes.items():
            if key < 0x110000:
                self.root[key] = to
        self.tree = Table(nodes)

    def find(self, code: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, number) of all pieces in characters ``code``, none going over the ``stop`` of its start; shorter ones first.

        A character outside the vocabulary is found as the number that stands for it.
        """
        node = self.root[code]
        lone = np.where(node >= 0, self.piece_at[node], -1)
        strange = np.flatnonzero(lone < 0)
        out = [(strange, np.ones(len(strange), np.int64), code[strange].astype(np.int64) + len(self.text))]
        at, length = np.flatnonzero(node >= 0), 1
        node = node[at]
        while len(at):
            number = self.piece_at[node]
            ends = number >= 0
            out.append((at[ends], np.full(int(ends.sum()), length), number[ends]))
            more = at + length < stop[at]
            at = at[more]
            node = self.tree.get(node[more].astype(np.int64) << 21 | code[at + length], -1)
            at, node, length = at[node >= 0], node[node >= 0], length + 1
        return tuple(np.concatenate(x) for x in zip(*out))

    def _trace(self, i: int) -> None:
        """Runs the merge rules (best score first, then leftmost) on one piece."""
        symbols, rank, step = list(self.text[i]), self.rank, 0
        number = lambda x: self.id.get(x, len(self.text) + ord(x[0]))
        while True:
            self.firsts[i, step], self.lasts[i, step] = number(symbols[0]), number(symbols[-1])
            best, at = _NEVER, -1
            for k, pair in enumerate(map(str.__add__, symbols, symbols[1:])):
                r = rank.get(pair)
                if r is not None and r < best:
                    best, at = r, k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            self.ranks[i, step] = best
            step += 1
        self.traced[i], self.whole[i] = True, len(symbols) == 1

    def stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merge rules, run on the characters of pieces a and b, end in a, b; for arrays of pairs.

        Until a merge goes over the boundary, each side's merges come in the
        order they have alone.  A character outside the vocabulary merges with
        nothing, and nothing stands before the start.
        """
        many = len(self.text)
        for x in (a, b):
            x = np.unique(x[x < many])
            for i in x[~self.traced[x]].tolist():
                self._trace(i)
        ok = (b >= many) | self.whole[np.minimum(b, many - 1)]
        ok &= (a >= many) | self.whole[np.minimum(a, many - 1)]
        todo = np.flatnonzero(ok & (a < many) & (b < many))
        a, b = a[todo], b[todo]
        i, j = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
        while len(todo):
            p, q = self.ranks[a, i], self.ranks[b, j]
            over = self.merges.get(self.lasts[a, i] << _BITS | self.firsts[b, j], _NEVER)
            bad = (over < p) & (over <= q)
            ok[todo[bad]] = False
            left = p <= q
            i, j = i + left, j + ~left
            go = ~bad & (np.minimum(p, q) < _NEVER)
            todo, a, b, i, j = todo[go], a[go], b[go], i[go], j[go]
        return ok

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stays`` through a direct-mapped cache."""
        key = a << _BITS | b
        slot = _hash(key) % PAIRS
        held = self.cache[slot]
        ok, lost = (held & 1).astype(bool), np.flatnonzero(held >> 1 != key)
        if len(lost):
            new, back = np.unique(key[lost], return_inverse=True)
            fits = self.stays(new >> _BITS, new % _WIDE)[back]
            ok[lost] = fits
            self.cache[slot[lost]] = key[lost] << 1 | fits
        return ok

    def _steps(self, i: int) -> tuple:
        """The merge rules on one piece, as lists, and whether they end in it."""
        if i not in self.steps:
            if not self.traced[i]:
                self._trace(i)
            self.steps[i] = (self.ranks[i].tolist(), self.firsts[i].tolist(), self.lasts[i].tolist(), bool(self.whole[i]))
        return self.steps[i]

    def _pair_stays(self, a: int, b: int) -> bool:
        """``stays`` for one pair."""
        many = len(self.text)
        if b >= many or a >= many:
            return (b >= many or self._steps(b)[3]) and (a >= many or self._steps(a)[3])
        ranks_a, _, lasts, whole_a = self._steps(a)
        ranks_b, firsts, _, whole_b = self._steps(b)
        if not (whole_a and whole_b):
            return False
        i = j = 0
        while True:
            p, q = ranks_a[i], ranks_b[j]
            over = self.merge_rank.get(lasts[i] << _BITS | firsts[j], _NEVER)
            if over < p and over <= q:
                return False
            if p == q == _NEVER:
                return True
            if p <= q:
                i += 1
            else:
                j += 1

    def _alone(self, text: str, at: int, before: int) -> Iterator[bytes]:
        """The streaming pass over one text, from boundary ``at`` after piece ``before``, in plain steps: some microseconds a character.

        Pieces are looked up for ALONE characters at once; the window of paths not yet committed is that of ``walk``.
        """
        many, fits, read = len(self.text), self.fits, ALONE
        while at < len(text):
            code = np.frombuffer(text[at : at + read].encode("utf-32-le", "surrogatepass"), np.uint32)
            size, base, wide = len(code), 0, 4 * self.longest
            start, long, number = self.find(code, np.full(size, size))
            order = np.argsort(start + long, kind="stable")
            start, end, number = start[order], (start + long)[order], number[order]
            last, come = [-1] * (size + 1), [0] * (size + 1)
            last[0] = before
            final = at + size == len(text)
            if len(fits) > PAIRS:
                fits.clear()
            i, r = 0, 0
            starts, ends, numbers = start.tolist(), end.tolist(), number.tolist()
            while r < size:
                r = min(base + wide, size)
                for i in range(i, int(np.searchsorted(end, r, "right"))):
                    s, n = starts[i], numbers[i]
                    key = last[s] << _BITS | n
                    if last[s] < 0:
                        continue
                    ok = fits.get(key)
                    if ok is None:
                        ok = fits[key] = self._pair_stays(last[s], n)
                    if ok:
                        last[ends[i]], come[ends[i]] = n, s
                i = int(np.searchsorted(end, r, "right"))
                to = r if final and r == size else base + self._meet([c - base for c in come[base : r + 1]], r - base)
                if to > base:
                    ids, at_ = [], to
                    while at_ > base:
                        ids.append(last[at_])
                        at_ = come[at_]
                    yield np.array([y for x in reversed(ids) for y in (self.bytes_ids(chr(x - many)) if x >= many else (x,))], np.int32).tobytes()
                    base, wide = to, 4 * self.longest
                else:
                    wide *= 2
            before, at, read = last[base], at + base, ALONE if base else 2 * read

    def walk(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """The streaming pass over texts side by side, one character a step: (number of the text, ids as packed ints) as they are committed.

        Of each text a window of ``4 * longest`` characters is held  At its end
        the surviving paths, those of the last ``longest`` boundaries, are
        followed back to the boundary that all share; the ids up to it are
        committed and the window moves there.  Where the paths share none but
        the window's start, the window doubles.
        """
        todo = [k for k, t in enumerate(texts) if t]
        whole, wide = np.fromiter(map(len, texts), np.int64, len(texts)), np.full(len(texts), 4 * self.longest)
        at, before = np.zeros(len(texts), np.int64), np.full(len(texts), _START)
        while todo:
            if len(todo) <= FEW:
                for k in todo:
                    for ids in self._alone(texts[k], int(at[k]), int(before[k])):
                        yield k, ids
                return
            now = np.array(todo)
            parts = [texts[k][i:j] for k, i, j in zip(todo, at[now].tolist(), (at + wide)[now].tolist())]
            size = np.minimum(whole[now] - at[now], wide[now])
            last, come, width = self._window(parts, size, before[now])
            end = size.copy()
            for i in np.flatnonzero(at[now] + size < whole[now]).tolist():
                end[i] = self._meet(come[i * width : (i + 1) * width] - i * width, int(size[i]))
            before[now] = last[np.arange(len(now)) * width + end]
            wide[now] = np.where(end > 0, 4 * self.longest, 2 * wide[now])
            at[now] += end
            for k, ids in zip(todo, self._paths(last, come, width, end)):
                if ids:
                    yield k, ids
            todo = now[at[now] < whole[now]].tolist()

    def _window(self, parts: list[str], size: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """At each boundary of each part, in rows of ``width``: number of the piece that ends there on the path, and where it starts."""
        width, first = int(size.max()) + 1, np.cumsum(size) - size
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lane = np.repeat(np.arange(len(parts)), size)
        at, long, number = self.find(code, (first + size)[lane])
        lane = lane[at]
        step = (at + long - first[lane]).astype(np.int16 if width < 1 << 15 else np.int64)  # small numbers sort by radix
        base = lane * width
        last, come = np.full(len(parts) * width, -1, np.int64), np.zeros(len(parts) * width, np.int64)
        last[::width] = before
        order = np.argsort(step, kind="stable")
        edge = np.searchsorted(step[order], np.arange(width + 1))
        for r in range(1, width):
            i = order[edge[r] : edge[r + 1]]
            to = base[i] + r
            start = to - long[i]
            reached = np.flatnonzero(last[start] >= 0)  # others start at a boundary that no path reaches
            to, start, n = to[reached], start[reached], number[i[reached]]
            ok = self._stable(last[start], n)
            to = to[ok]
            last[to], come[to] = n[ok], start[ok]
        return last, come, width

    def _meet(self, come: np.ndarray, size: int) -> int:
        """The last boundary that all surviving paths go through: those of the last ``longest`` boundaries."""
        paths = set(range(max(0, size - self.longest + 1), size + 1))
        while len(paths) > 1:
            top = max(paths)
            paths.remove(top)
            paths.add(int(come[top]))
        return paths.pop()

    def _paths(self, last: np.ndarray, come: np.ndarray, width: int, end: np.ndarray) -> list[bytes]:
        """The ids of the paths to boundary ``end`` of each part."""
        many, at, steps = len(self.text), np.arange(len(end)) * width + end, []
        last[::width], come[::width] = -1, np.arange(len(end)) * width  # paths wait at their start
        while len(now := last[at]) and now.max() >= 0:
            steps.append(now)
            at = come[at]
        paths = np.array(steps, np.int32)[::-1].T if steps else np.full((len(end), 1), -1, np.int32)
        held = paths >= 0
        flat, ends = paths[held].tobytes(), (4 * np.cumsum(held.sum(1))).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for k in np.flatnonzero((paths >= many).any(1)).tolist():
            ids = np.frombuffer(out[k], np.int32).tolist()
            out[k] = np.array([i for x in ids for i in (self.bytes_ids(chr(x - many)) if x >= many else (x,))], np.int32).tobytes()
        return out

    def bytes_ids(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "replace")]

    def bytes_of(self, i: int) -> bytes:
        if self.kind[i] == 6:
            return bytes([int(self.text[i][1:-1], 16)])
        if self.kind[i] in (2, 3):  # unknown, control
            return " \u2047 ".encode() if self.kind[i] == 2 else b""
        return self.text[i].replace(MARK, " ").encode("utf-8")

    def _runs(self, texts: list[str]) -> Iterator[list[tuple[int, list[str]]]]:
        """The texts' units in runs of about ``RUN`` characters: [(number of the text, units)]; a long text goes over several runs."""
        run, size = [], 0
        for k, text in enumerate(texts):
            text, i = f" {text.replace(MARK, ' ')}" if text else "", 0
            while i < len(text):
                end = min(len(text), i + RUN - size) if self.cuts else len(text)
                while end < len(text) and (text[end] not in " \n" or text[end - 1] in " \n"):
                    end += 1  # to the end of the unit
                run.append((k, _UNIT.findall(text, i, end) if self.cuts else [text]))
                size += end - i
                i = end
                if size >= RUN:
                    yield run
                    run, size = [], 0
        yield run

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts, committed run by run."""
        out: list[list[bytes]] = [[] for _ in texts]
        for run in self._runs(texts):
            known = self.words.turn()
            new = set().union(*(units for _, units in run)).difference(known)
            unseen = [u for u in new if not self.words.again(u)]
            for k, ids in self.walk([u.replace(" ", MARK) for u in unseen]):
                u = unseen[k]
                known[u] = known[u] + ids if u in known else ids
            for k, units in run:
                out[k].append(b"".join(map(known.__getitem__, units)))
            for u in new:
                if len(u) > 64:
                    del known[u]
        return [np.frombuffer(b"".join(parts), np.int32) for parts in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Memo:
    """Two generations of remembered ids, packed: what is asked for again outlives the older one."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> dict[str, bytes]:
        """The younger generation, which holds at most ``MEMO`` units before a run."""
        if len(self.new) > MEMO:
            self.old, self.new = self.new, {}
        return self.new

    def again(self, unit: str) -> bool:
        """Takes a unit over from the older generation, if it is there."""
        ids = self.old.get(unit)
        if ids is not None:
            self.new[unit] = ids
        return ids is not None


_loaded: dict[bytes, Pieces] = {}


def _pieces(shared) -> Pieces:
    """One vocabulary a worker process, kept with its memo between tasks."""
    model = shared.value
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def _broadcast(df: DataFrame, model: str):
    with open(model, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a model file: about 0.5 MB


def encode(documents: DataFrame, text: str = "text", model: str = MODEL, out: str = "ids") -> DataFrame:
    """Add the ids of a text column."""
    shared = _broadcast(documents, model)

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = _pieces(shared)
        for s in parts:
            for i in range(0, len(s), 500):  # ids leave in small batches
                own = s.iloc[i : i + 500]
                got = p.encode_all([t or "" for t in own])
                yield pd.Series([None if t is None else g for t, g in zip(own, got)], dtype=object)

    return documents.withColumn(out, ids.asNondeterministic()(text))


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL, out: str = "decoded") -> DataFrame:
    """Add the text of a column of ids, in the JVM.  Ids outside the vocabulary add nothing.

    The texts of the pieces are joined; where some are bytes of characters
    beyond ASCII, the bytes of all pieces are.
    """
    with open(model, "rb") as f:
        p = Pieces(f.read())
    raw = [p.bytes_of(i) for i in range(len(p.text))]
    if any(c in t for t in p.text for c in _PRIVATE):
        raise ValueError("pieces hold the characters that mark entries here")
    part = [_PRIVATE[1] if p.kind[i] == 6 and b[0] > 127 else b.decode("utf-8") for i, b in enumerate(raw)]
    texts, hexes = F.split(F.lit(_PRIVATE[0].join(part)), _PRIVATE[0], -1), F.split(F.lit(",".join(b.hex() for b in raw)), ",", -1)
    joined, text = (free(encoded, f"__{n}") for n in ("joined", "text"))
    # columns of their own, so that each is computed once
    df = encoded.withColumn(joined, F.array_join(F.transform(ids, lambda i: F.get(texts, i)), ""))
    by_bytes = F.make_valid_utf8(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(hexes, i)), "")).cast("string"))
    df = df.withColumn(text, F.when(F.contains(joined, F.lit(_PRIVATE[1])), by_bytes).otherwise(F.col(joined)))
    return df.withColumn(out, F.when(F.startswith(text, F.lit(" ")), F.substring(F.col(text), F.lit(2), F.length(text))).otherwise(F.col(text))).drop(joined, text)
