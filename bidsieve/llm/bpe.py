"""BPE encoding and decoding with forced-boundary splitting.

A merge can only join two bytes that stand side by side inside some vocabulary token. Byte pairs that stand in none are
certain cuts: no merge ever crosses them, so the fragments between them are encoded alone, each different one once, and
their ids are concatenated. Where a cut lies before a space that follows a character other than white space, the pattern
that splits words ends there too, so whole texts are first cut at these places without applying the pattern.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, slices, text_of

#: The published word pattern of byte-level BPE, a fixed value.
_WORDS = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
_WHITE_SPACE = [c + " " for c in map(chr, range(0x3001)) if c.isspace()]
#: Pieces and fragments, each, that a worker keeps.
_LIMIT = 450_000


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one byte-level vocabulary file. The library's merge loop sees one fragment at a time."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_characters()
        self.characters = {b: c for c, b in back.items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        plain = [t for t in vocab if t not in self.added]
        tokens = {vocab[t]: bytes(back[c] for c in t) for t in plain} | {i: t.encode() for t, i in self.added.items()}
        self.inside = np.zeros(1 << 16, bool)  # byte pairs inside some token, as first * 256 + second
        for t in plain:
            shown = tokens[vocab[t]]
            for pair in zip(shown, shown[1:], strict=False):
                self.inside[pair[0] << 8 | pair[1]] = True
        by_id = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.table, self.length = np.frombuffer(b"".join(by_id), np.uint8), np.array([len(t) for t in by_id])
        self.start = np.cumsum(self.length) - self.length
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        # certain unless some token holds a space behind a character other than white space
        self.cuts_before_space = not any(re.search(r"\S ", tokens[vocab[t]].decode("utf-8", "ignore")) for t in plain)
        self.merge = Tokenizer.from_file(path).model.tokenize
        self.fragments: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}  # ids of pieces
        self.spaced: dict[str, bytes] = {}  # ids of pieces that begin with a space, by what follows it

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that no merge leaves: cut into words by the pattern, then at the byte pairs that no token holds."""
        words = [_WORDS.findall(x) for x in pieces]
        raw, offsets = bytes_of(pa.array([w for ws in words for w in ws], pa.string()))
        cut = np.ones(len(raw) + 1, bool)
        cut[1:-1] = ~self.inside[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        shown = raw.tobytes().decode("latin-1").translate(self.characters)
        at = bounds.tolist()
        found = [shown[a:b] for a, b in zip(at, at[1:], strict=False)]
        known, merge = self.fragments, self.merge
        _shed(known)
        for x in set(found).difference(known):
            known[x] = array("i", [t.id for t in merge(x)]).tobytes()
        ends = np.searchsorted(bounds, offsets[np.cumsum([len(ws) for ws in words], dtype=np.int64)]).tolist()
        return [known[found[a]] if b - a == 1 else b"".join([known[x] for x in found[a:b]]) for a, b in zip([0, *ends], ends, strict=False)]

    def pieces(self, text: str) -> tuple[list[str], list[str]]:
        """A text without added tokens, cut at the certain cuts before spaces: what is ahead of the first, and what follows their spaces."""
        if not self.cuts_before_space:
            return [text], []
        if not text.startswith(" ") and not any(x in text for x in _WHITE_SPACE):
            head, *rest = text.split(" ")
            return [head], rest
        head, *rest = _BEFORE_SPACE.split(text)  # a space behind white space belongs to it
        return [head], [x[1:] for x in rest]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as the bytes of 32-bit numbers; each different piece of them all is encoded once."""
        cut = [[self.pieces(x) if i % 2 == 0 else x for i, x in enumerate(self.specials.split(t) if self.specials else [t])] for t in texts]
        plain = [x for parts in cut for x in parts[::2]]
        far = []
        for known, before, asked in ((self.first, "", (x[0] for x in plain)), (self.spaced, " ", (x[1] for x in plain))):
            _shed(known)
            fresh = list(set().union(*asked).difference(known))
            known.update(zip(fresh, self.learn([before + x for x in fresh]), strict=True))
            far += [(known, x) for x in fresh if len(x) >= 40]
        first, spaced = self.first.__getitem__, self.spaced.__getitem__
        out = [b"".join([y for i, x in enumerate(parts) for y in ((np.int32(self.added[x]).tobytes(),) if i % 2 else (*map(first, x[0]), *map(spaced, x[1])))]) for parts in cut]
        for known, x in far:  # long pieces hardly come back
            del known[x]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all([text])[0], np.int32)

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Text of each stretch of ids between offsets."""
        n = self.length[ids]
        ends = np.concatenate(([0], np.cumsum(n)))
        data = self.table[np.repeat(self.start[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        at = ends[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


def _shed(known: dict[str, bytes]) -> None:
    """Let the older half go where too many are held."""
    if len(known) > _LIMIT:
        for old in list(islice(known, _LIMIT // 2)):
            del known[old]


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in (s for b in batches for s in slices(b, "text")):
            ids = bpe.encode_all(batch.column("text").to_pylist())
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))], ["doc_id", "ids"])

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            lists = batch.column("ids").fill_null([])
            texts = bpe.decode_all(lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids array<int> of each whole text with the byte-level vocabulary file at `path` (on every machine).

    docs: doc_id long, text string; other columns are ignored, whatever their names. A null or empty text has no ids;
    added tokens in a text get their own id; null and repeated doc_ids are kept; an empty table gives an empty result.
    """
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(_encoded(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text of encoded rows; bytes that aren't UTF-8 become replacement characters; null ids an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """The contract's columns."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
