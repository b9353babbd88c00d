"""Packing by order-preserving dynamic programming.

Documents are kept in order. Windows of at most `limit` tokens are cut from the token stream at document ends, at sentence
ends, or, only where neither comes for long, in between. The dynamic program minimises padding plus a penalty for every
document that a cut truncates; the best predecessor of a cut is the minimum over a sliding window of earlier cuts, kept in
a monotone queue, so the work is linear in the number of cuts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import parts, slices, text_of

_PIECES = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_LIMIT = 600_000
#: Fixed values of the published word-end vocabulary, on which the cuts of `Words` rest.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters and digits that normalisation leaves one letter or digit, so that a mark behind them is a word of its own.
_ENDS_A_WORD = pa.array([c for c in map(chr, range(0x250)) if c.isalnum() and unicodedata.is_normalized("NFC", c) and len(c.lower()) == 1 and c.lower().isalnum()])


class Words:
    """Ids of texts by a word-end vocabulary that drops white space, each different stretch between spaces encoded once.

    Texts of a vocabulary with another normaliser or word pattern go whole to the library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre = (spec.get(x) or {} for x in ("normalizer", "pre_tokenizer"))
        split = next((x for x in pre.get("pretokenizers", []) if x["type"] == "Split"), {})
        self.cuts = [x["type"] for x in norm.get("normalizers", [])] == _NORMALIZERS and split.get("pattern") == {"Regex": _WORDS} and spec["model"].get("end_of_word_suffix") == "</w>"
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.characters = {b: c for c, b in byte_characters().items()}
        #: lower-case letters of Latin-1 alone: one word of the pattern, left as it is by the normaliser
        self.one_word = re.compile("[a-zß-öø-ÿ]+").fullmatch
        self.stops = np.array(sorted(i for t, i in self.tokenizer.get_vocab().items() if t.removesuffix("</w>").strip(".!?") == "" and t.removesuffix("</w>")), np.int32)

    def learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Ids of stretches that are not kept; their stems, which are far fewer, are kept from now on. ASCII letters are lowered by the vocabulary anyway, and a run of marks behind a
        letter or digit is a word of its own, so only the plain stems go to the library."""
        known = self.known
        given = pc.ascii_lower(pa.array(fresh, pa.string()))
        stem = pc.ascii_rtrim(given, characters=".,;:!?")
        stem = pc.if_else(pc.is_in(pc.utf8_slice_codeunits(stem, -1), _ENDS_A_WORD), stem, given)
        stems, sizes = stem.to_pylist(), pc.utf8_length(stem).to_pylist()
        tails = [x[n:] for x, n in zip(fresh, sizes, strict=True)]
        asked = set(stems).union(tails).difference(known)
        one, merge, shown = self.one_word, self.tokenizer.model.tokenize, self.characters
        for x in [x for x in asked if one(x)]:
            known[x] = array("i", [t.id for t in merge(x if x.isascii() else x.encode().decode("latin-1").translate(shown))]).tobytes()
        asked = list(asked.difference(known))
        for i in range(0, len(asked), 10_000):
            some = asked[i : i + 10_000]
            for x, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[x] = array("i", e.ids).tobytes()
        return dict(zip(fresh, [known[s] + known[t] for s, t in zip(stems, tails, strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cuts:
            return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        known = self.known
        if len(known) > _LIMIT:  # the newer half stays
            for old in list(islice(known, _LIMIT // 2)):
                del known[old]
            known[""] = b""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        ids = [list(map(known.get, words)) for words in cut]
        gaps = [[i for i, x in enumerate(found) if x is None] for found in ids]
        learned = self.learn(list({words[i] for words, some in zip(cut, gaps, strict=True) for i in some}))
        for words, found, some in zip(cut, ids, gaps, strict=True):
            for i in some:
                found[i] = learned[words[i]]
        return [np.frombuffer(b"".join(found), np.int32) for found in ids]


@cache
def load(path: str) -> Words:
    return Words(path)


def best_cuts(at: list[int], penalty: list[int], limit: int) -> list[int]:
    """Indices of the cuts to take among candidates at rising positions (the first at 0; steps of `limit` at most).

    Minimises the sum over windows of (limit - length) plus the penalties of the cuts taken; ends with the last candidate.
    """
    cost, last = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, index), rising
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0][1]] > limit:
            queue.popleft()
        value, last[j] = queue[0]
        value += limit - here + penalty[j]
        cost[j] = value
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    chosen = [len(at) - 1]
    while chosen[-1]:
        chosen.append(last[chosen[-1]])
    return chosen[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, sentence: int, hard: int, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut and their penalties: 0 and the ends of documents, sentence ends, and steps of `stretch` in long gaps."""
    kind = np.zeros(len(ids) + 1, np.int8)
    stop = np.zeros(max(int(ids.max(initial=0)), int(stops.max(initial=0))) + 1, bool)
    stop[stops] = True
    kind[1:][stop[ids]] = 1
    kind[0] = 2
    kind[ends] = 2
    at = np.flatnonzero(kind)
    wide = np.flatnonzero(np.diff(at) > stretch)
    if len(wide):
        between = np.concatenate([np.arange(at[i] + stretch, at[i + 1], stretch) for i in wide])
        kind[between] = 3
        at = np.flatnonzero(kind)
    return at, np.array([0, sentence, 0, hard])[kind[at]]


def _packed(path: str, limit: int, end_id: int, sentence: int, hard: int, block: int):
    def flush(docs: list[tuple], stops: np.ndarray, final: bool, next_id: list[int]) -> tuple[pa.RecordBatch | None, list[tuple]]:
        """Pack what is held: (doc_id, ids, start, doc_tokens) of documents or their rests. All but the last window leaves."""
        ids = np.concatenate([d[1] for d in docs])
        ends = np.cumsum([len(d[1]) for d in docs])
        at, penalty = candidates(ids, ends, stops, sentence, hard, min(512, limit))
        chosen = at[best_cuts(at.tolist(), penalty.tolist(), limit)]
        if not final:
            chosen = chosen[:-1]
        bounds = np.unique(np.concatenate((chosen, ends[ends <= chosen[-1]])))
        starts, stop = bounds[:-1], bounds[1:]
        doc = np.searchsorted(ends, starts, side="right")
        begin = ends - np.array([len(d[1]) for d in docs])
        window = np.searchsorted(chosen, starts, side="right") - 1
        first = np.array([d[2] for d in docs])[doc] + starts - begin[doc]
        flat = ids[: bounds[-1]].astype("<i4")
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), stop.tolist(), strict=True)]
        columns = [pa.array([docs[i][0] for i in doc], pa.int64()), pa.array(first.astype(np.int64)), pa.array(stop - starts), lists, pa.array(crc, pa.int64()), pa.array(np.array([d[3] for d in docs], np.int64)[doc]), pa.array(next_id[0] + window), pa.array(starts - chosen[window])]
        next_id[0] += len(chosen) - 1
        rest = []
        for i in range(int(np.searchsorted(ends, chosen[-1], side="right")), len(docs)):
            skip = max(0, int(chosen[-1] - begin[i]))
            rest.append((docs[i][0], docs[i][1][skip:], docs[i][2] + skip, docs[i][3]))
        return (pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]) if len(starts) else None), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = load(path)
        next_id = [TaskContext.get().partitionId() << 40]
        held: list[tuple] = []
        size = 0
        for batch in (s for b in batches for s in slices(b, "text", 4 << 20)):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist()), strict=True):
                ids = np.append(ids, np.int32(end_id))
                held.append((doc_id, ids, 0, len(ids)))
                size += len(ids)
            if size >= block:
                out, held = flush(held, words.stops, False, next_id)
                size = sum(len(d[1]) for d in held)
                if out is not None:
                    yield out
        if held:
            out, _ = flush(held, words.stops, True, next_id)
            if out is not None:
                yield out

    return run


def pack(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 1, sentence: int = 8, hard: int = 256, block: int = 1 << 19) -> DataFrame:
    """Pieces of documents, packed in order of doc_id into sequences of at most `limit` tokens.

    docs: doc_id long, text string; other columns are ignored, whatever their names. A document is the ids of its text by the
    vocabulary file at `path` and then `end_id`. Returns per piece doc_id, start (ids of the document before it), length,
    ids, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id (unique, with gaps) and offset in the sequence. Each id lies in exactly one piece.
    A null or empty text is the end id alone; repeated rows are packed each; null doc_ids come first; an empty table gives an
    empty result. The table is dealt by ranges of doc_id (and the hash of the text, where ids are the same); a task holds the tokens of about `block` and 4 MB of text at once (and one document).
    `sentence` and `hard` are the padding tokens that a cut after a sentence, or anywhere else in a document, may save at least.
    """
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    # rows that share an id, or have none, are many ranges too
    return base.repartitionByRange(parts(docs), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id").mapInArrow(_packed(path, limit, end_id, sentence, hard, block), _PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns."""
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
