"""N-best segmentation over a SentencePiece vocabulary, and exact decoding.

A text becomes a lattice of pieces, each with its score. A forward Viterbi pass
gives the best score of every prefix; those scores are exact heuristics for an
A-star search that runs backward from the end and so pops segmentations in the
order of their scores.

Pieces do not cross the start of a run of spaces, nor a character that no
longer piece contains, so a text's lattice is a chain of small ones, its
units. The forward pass runs over the distinct units of a batch at once. A
text's N best differ from its best in its units of smallest loss only: the
N - 1 units whose second segmentation loses least are enough, for any choice
among others could be replaced by a better one. Only those units are searched
backward, and their losses are merged into the N best of the text.

A character that is no piece is spelled in the vocabulary's byte pieces and
scores like an unknown character. U+2581, which stands for a space in pieces,
is spelled in bytes too where a text has it, so decoding gives back the text.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
_LONGEST_UNIT = 24
_LITERAL = "\ud800"  # no text of a table has a lone surrogate; it stands in for a literal U+2581


class Vocabulary:
    """Pieces and scores of a SentencePiece model with byte fallback and no text normalisation."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if sp.normalize("a  b\té ") != f"{SPACE}a{SPACE}{SPACE}b\té{SPACE}":
            raise ValueError("the model normalises its text; decoding would not give it back")
        self.size = len(sp)
        self.bytes = {}
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.text: list[str] = [""] * self.size
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece] = i
                self.score[piece] = sp.get_score(i)
                self.text[i] = piece.replace(SPACE, " ")
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        self.longest = max(map(len, self.id))
        self.unknown = min(self.score.values()) - 10.0
        shared = {c for p in self.id if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("the model has pieces across words")
        lone = [c for c in "\n\t\r" if c not in shared]
        cuts = re.escape("".join(lone))
        self.units = re.compile(rf"{SPACE}+[^{SPACE}{cuts}]*|[{cuts}]|[^{SPACE}{cuts}]+" if lone else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self._hash()

    def _hash(self):
        """Open table from polynomial hashes of the pieces to their numbers."""
        base = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.base = base
        names = list(self.id)
        with np.errstate(over="ignore"):
            keys = []
            for name in names:
                h = np.uint64(0)
                for c in name:
                    h = h * base + np.uint64(ord(c) + 1)
                keys.append(h ^ np.uint64(len(name)))
            self.keys = np.array(keys, dtype=np.uint64)
        if len(np.unique(self.keys)) != len(names):
            raise ValueError("piece hashes collide")
        bits = 19
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.chains = 0
        for n, k in enumerate(self.keys.tolist()):
            at, tried = ((k * 0xD1342543DE82EF95) & (2**64 - 1)) >> (64 - bits), 0
            while self.slots[at] >= 0:
                at, tried = (at + 1) & ((1 << bits) - 1), tried + 1
            self.slots[at] = n
            self.chains = max(self.chains, tried)
        self.piece_ids = np.array([self.id[n] for n in names], dtype=np.int32)
        self.piece_scores = np.array([self.score[n] for n in names])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for none."""
        with np.errstate(over="ignore"):
            at = ((keys * np.uint64(0xD1342543DE82EF95)) >> self.shift).astype(np.int64)
        slot = self.slots[at]
        found = np.where((slot >= 0) & (self.keys[slot] == keys), slot, -1)
        open_ = np.flatnonzero((slot >= 0) & (found < 0))
        for step in range(1, self.chains + 1):
            if not len(open_):
                break
            slot = self.slots[(at[open_] + step) & int(self.mask)]
            hit = (slot >= 0) & (self.keys[slot] == keys[open_])
            found[open_[hit]] = slot[hit]
            open_ = open_[(slot >= 0) & ~hit]
        return found

    def spelled(self, char: str) -> list[int]:
        return [self.bytes[b] for b in (SPACE if char == _LITERAL else char).encode("utf-8", "surrogatepass")]

    def arcs(self, unit: str, end: int) -> list[tuple[int, float, list[int]]]:
        """(start, score, ids) of the pieces of ``unit`` that end at ``end``."""
        out = []
        for start in range(max(0, end - self.longest), end):
            piece = unit[start:end]
            if piece in self.id:
                out.append((start, self.score[piece], [self.id[piece]]))
        if unit[end - 1] not in self.id:
            out.append((end - 1, self.unknown, self.spelled(unit[end - 1])))
        return out

    def n_best(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of one unit: forward Viterbi, then A-star backward."""
        best = [0.0] + [-np.inf] * len(unit)
        into: list[list] = [[]]
        for end in range(1, len(unit) + 1):
            into.append(self.arcs(unit, end))
            best[end] = max(best[start] + score for start, score, _ in into[end])
        order = count()
        # (negated estimate of the whole, order, score from here to the end, place, pieces behind)
        agenda = [(-best[-1], next(order), 0.0, len(unit), None)]
        found = []
        while agenda and len(found) < n:
            _, _, behind, at, tail = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while tail is not None:
                    ids += tail[0]
                    tail = tail[1]
                found.append((behind, ids))
                continue
            for start, score, ids in into[at]:
                heapq.heappush(agenda, (-(best[start] + score + behind), next(order), score + behind, start, (ids, tail)))
        return found

    def viterbi(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best score, loss of the second best, ids, offsets) of the units; the loss is inf without a second.

        Units of one length run together; a unit longer than ``_LONGEST_UNIT``
        is searched on its own.
        """
        total = len(units)
        score, loss = np.zeros(total), np.full(total, np.inf)
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=total)
        owners, found = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for at in np.flatnonzero(lengths > _LONGEST_UNIT).tolist():
            two = self.n_best(units[at], 2)
            score[at] = two[0][0]
            if len(two) > 1:
                loss[at] = two[0][0] - two[1][0]
            owners.append(np.full(len(two[0][1]), at))
            found.append(np.array(two[0][1], dtype=np.int32))
        for size in range(1, _LONGEST_UNIT + 1):
            who = np.flatnonzero(lengths == size)
            for lo in range(0, len(who), 16384):
                own, ids = self._like(units, who[lo : lo + 16384], size, score, loss)
                owners.append(own)
                found.append(ids)
        owner, ids = np.concatenate(owners), np.concatenate(found)
        order = np.argsort(owner, kind="stable")
        return score, loss, ids[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=total))].astype(np.int64)

    def _like(self, units, who, size, score, loss):
        n = len(who)
        joined = "".join([units[i] for i in who.tolist()])
        chars = np.ascontiguousarray(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, size).T).astype(np.uint64)
        first, second = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        first[0] = 0
        back = np.zeros((size + 1, n), dtype=np.int8)
        piece = np.full((size + 1, n), -1, dtype=np.int32)
        hashes = [np.zeros(n, dtype=np.uint64) for _ in range(size)]
        with np.errstate(over="ignore"):
            for end in range(1, size + 1):
                code = chars[end - 1] + np.uint64(1)
                for start in range(max(0, end - self.longest), end):
                    h = hashes[start] = hashes[start] * self.base + code
                    number = self.find(h ^ np.uint64(end - start))
                    some = np.flatnonzero(number >= 0) if start < end - 1 else np.arange(n)
                    if not len(some):
                        continue
                    # Most substrings are no piece; only the others are relaxed.
                    number = number[some]
                    gain = np.where(number >= 0, self.piece_scores[number], self.unknown)
                    a, b = first[start, some] + gain, second[start, some] + gain
                    old, runner = first[end, some], second[end, some]
                    better = a > old
                    second[end, some] = np.where(better, np.maximum(old, b), np.maximum(runner, a))
                    first[end, some] = np.where(better, a, old)
                    back[end, some] = np.where(better, start, back[end, some])
                    piece[end, some] = np.where(better, number, piece[end, some])
        score[who] = first[size]
        loss[who] = first[size] - second[size]
        column, end = np.arange(n), np.full(n, size)
        columns, values = [], []
        while len(column):
            number, start = piece[end, column], back[end, column].astype(np.int64)
            columns.append(column)
            values.append(np.where(number >= 0, self.piece_ids[number], -end))
            alive = start > 0
            column, end = column[alive], start[alive]
        column, value = np.concatenate(columns[::-1]), np.concatenate(values[::-1])
        order = np.argsort(column, kind="stable")
        column, value = column[order], value[order]
        odd = np.flatnonzero(value < 0)
        if len(odd):
            spelled = [self.spelled(joined[column[k] * size - value[k] - 1]) for k in odd.tolist()]
            width = np.ones(len(value), dtype=np.int64)
            width[odd] = list(map(len, spelled))
            begin = np.cumsum(width) - width
            column, value = np.repeat(column, width), np.repeat(value, width)
            for k, own in zip(begin[odd].tolist(), spelled):
                value[k : k + len(own)] = own
        return who[column], value.astype(np.int32)

    def cut(self, text: str) -> list[str]:
        """The units of a text, with a space put before it and spaces as U+2581; none of an empty text."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, _LITERAL)
        return self.units.findall(SPACE + text.replace(" ", SPACE))

    def decode(self, ids) -> str:
        """The text whose segmentation the ids are."""
        if not hasattr(self, "_spelling"):
            self._spelling = [t.encode() for t in self.text]
            for byte, i in self.bytes.items():
                self._spelling[i] = bytes([byte])
        raw = b"".join(map(self._spelling.__getitem__, ids))
        return raw[1:].decode("utf-8")


def _merged(losses: list[tuple[int, list[float]]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The ``n`` cheapest ways to replace units: (loss, unit -> rank of its segmentation)."""
    ways: list[tuple[float, tuple]] = [(0.0, ())]
    for unit, own in losses:
        new = [(w + own[r], choice + ((unit, r),) if r else choice) for w, choice in ways for r in range(len(own))]
        ways = heapq.nsmallest(n, new)
    return [(w, dict(choice)) for w, choice in ways]


def _ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``rows`` of a ragged array, one after another, and their sizes."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(sizes)
    at = np.repeat(offsets[rows] - (ends - sizes), sizes)
    at += np.arange(len(at))
    return values[at], sizes


class Encoder:
    """Encodes texts and remembers the units that it has met, up to ``remembered`` of them."""

    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST, remembered: int = 300_000):
        self.vocabulary, self.n, self.remembered = vocabulary, n, remembered
        self._forget()

    def _forget(self):
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.searched: dict[int, list] = {}
        self.score, self.loss = np.empty(0), np.empty(0)
        self.ids, self.offsets = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _learn(self):
        met = len(self.score)
        if len(self.numbers) > met:
            new = list(self.numbers)[met:]
            score, loss, ids, offsets = self.vocabulary.viterbi(new)
            self.score, self.loss = np.r_[self.score, score], np.r_[self.loss, loss]
            self.offsets = np.r_[self.offsets, offsets[1:] + len(self.ids)]
            self.ids = np.r_[self.ids, ids]

    def encode(self, texts: list) -> tuple[list, list]:
        """(ids, n-best) of each text; both None for None.

        ``ids``: the best segmentation. ``n-best``: up to ``n`` pairs (score,
        changes), best first; ``changes`` are (at, drop, ids): at place ``at``
        of the best segmentation, ``ids`` replace ``drop`` pieces.
        """
        if len(self.numbers) > self.remembered:
            self._forget()
        cut, number = self.vocabulary.cut, self.numbers.__getitem__
        codes = [np.fromiter(map(number, cut(t)), dtype=np.int64) if t else np.empty(0, np.int64) for t in texts]
        self._learn()
        names: list[str] = []
        all_ids, all_best = [], []
        few = self.n - 1
        for text, code in zip(texts, codes):
            if text is None:
                all_ids.append(None)
                all_best.append(None)
                continue
            own, sizes = _ragged(self.ids, self.offsets, code)
            all_ids.append(own)
            lost = self.loss[code]
            if few and len(lost) > few:
                edge = np.partition(lost, few - 1)[few - 1]
                near = np.flatnonzero(lost <= edge)
                near = near[np.argsort(lost[near], kind="stable")][:few]
            else:
                near = np.arange(len(lost) if few else 0)
            near = np.sort(near[np.isfinite(lost[near])])
            ranked = {}
            for k in near.tolist():
                unit = int(code[k])
                if unit not in self.searched:
                    if not names:
                        names = list(self.numbers)
                    self.searched[unit] = self.vocabulary.n_best(names[unit], self.n)
                ranked[k] = self.searched[unit]
            ways = _merged([(k, [found[0][0] - s for s, _ in found]) for k, found in ranked.items()], self.n)
            top = float(self.score[code].sum())
            starts = np.cumsum(sizes) - sizes
            all_best.append([(top - w, [(int(starts[k]), int(sizes[k]), ranked[k][r][1]) for k, r in choice.items()]) for w, choice in ways])
        return all_ids, all_best


def segmentations(ids, n_best) -> list[tuple[float, list[int]]]:
    """The n-best list written out: (score, ids) of each segmentation."""
    out = []
    for score, changes in n_best:
        own = list(ids)
        for at, drop, new in sorted(changes, reverse=True):
            own[at : at + drop] = new
        out.append((score, own))
    return out


_BEST = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
_LOADED: dict[str, Vocabulary] = {}


def vocabulary(model: str = MODEL) -> Vocabulary:
    """The model's vocabulary, read once in each process."""
    if model not in _LOADED:
        _LOADED[model] = Vocabulary(model)
    return _LOADED[model]


def _encoder(model: str, n: int, slice_chars: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        encoder = Encoder(own, n)
        for batch in batches:
            texts = batch.column("t").to_pylist()
            lo = 0
            while lo < len(texts) or (lo == 0 and not texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars < slice_chars):
                    chars += len(texts[hi] or "")
                    hi += 1
                part = texts[lo:hi]
                ids, best = encoder.encode(part)
                exact = [None if t is None else own.decode(i.tolist()) == t for t, i in zip(part, ids)]
                sizes = np.array([0 if i is None else len(i) for i in ids], dtype=np.int64)
                held = [i for i in ids if i is not None]
                flat = pa.array(np.concatenate(held) if held else np.empty(0, np.int32), type=pa.int32())
                missing = np.array([i is None for i in ids], dtype=bool)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat, mask=pa.array(missing)) if part else pa.array([], type=pa.list_(pa.int32()))
                named = [
                    None if rows is None else [{"score": s, "changes": [{"at": a, "drop": d, "ids": i} for a, d, i in changes]} for s, changes in rows]
                    for rows in best
                ]
                passed = [c for c in batch.schema.names if c != "t"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in passed), lists, pa.array(named, type=_BEST), pa.array(exact, type=pa.bool_())], names=[*passed, "ids", "n_best", "exact"])
                if not texts:
                    break
                lo = hi

    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, n: int = N_BEST, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, ids, n_best, exact), one row for each input row.

    ``ids`` is the best segmentation and ``n_best`` the ``n`` best, each as its
    score and its changes to ``ids`` (see :meth:`Encoder.encode`). ``exact`` says that
    decoding ``ids`` gave back the text. Of segmentations with equal scores
    the order is the same in every run. An empty text has no ids and one
    segmentation of score 0; a null text has nulls. Texts are encoded whole,
    however long. Null ids and repeated rows pass through, an empty table gives
    no rows. ``keep`` names other columns to pass on; one that is named like a
    column of the result, in any case, comes back with ``_in`` added to it as
    often as needed. The others are not looked at.

    Only texts and what is passed on reach Python; rows are encoded where they
    are read.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    taken, names = {"doc_id", "ids", "n_best", "exact"}, []
    for name in keep:
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        names.append(name)
    private = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    src = private.select(F.col(at[id_col]).alias("doc_id"), F.col(at[text_col]).cast("string").alias("t"), *(F.col(at[c]).alias(f"k{i}") for i, c in enumerate(keep)))
    kinds = [(f.name, f.dataType.simpleString()) for f in src.schema.fields if f.name != "t"]
    shape = ", ".join(f"{c} {kind}" for c, kind in kinds) + ", ids array<int>, n_best array<struct<score: double, changes: array<struct<at: int, drop: int, ids: array<int>>>>>, exact boolean"
    return src.mapInArrow(_encoder(model, n), shape).toDF("doc_id", *names, "ids", "n_best", "exact")


def decoded(encodings: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) from ids; a null for null ids, an empty text for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if i is None else own.decode(i) for i in lists], type=pa.string())], names=["doc_id", "text"])

    src = encodings.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")
