"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 6).

Texts are cut into words by the tokenizer's pattern; each partition encodes its distinct words in an embedded DuckDB: the
words' token-position rows join the merge table, every word's pair of least rank is contracted where it stands leftmost
(and where it stands again without overlap, which is the same as doing so one by one, since a merge only ever makes pairs
of higher rank) until no pair is left; an ordered aggregation gives each word's ids, which are put together by document.
The recursion only keeps the live tokens, one row for each byte at most.

A word of more than ``WINDOW`` bytes is contracted in overlapping windows, as the rounds of one long word would be as many
as its pairs have ranks. A list of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of
theirs (the first contraction across a boundary would also be made in the two neighbours alone), so two windows that have
a token in common at the same bytes may be joined there. Where they have none, as in periodic runs, the next window starts
at a token of the one before; should even that share no token, it is doubled.

Cases: a null, empty or missing text has the empty list; what looks like a special token is plain text; a lone surrogate is
encoded as U+FFFD; one row for each input row (ids aren't deduplicated); further columns are ignored.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DIRECTORY = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: The word pattern of byte-level BPE tokenizers of this family.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
MEMO = 400_000  # words of at most 64 characters whose ids a worker remembers
BATCH_BYTES = 500_000  # bytes of words that are contracted at once
WINDOW, STRIDE = 256, 160  # bytes of a long word that are contracted at once, and how far their windows are apart
CHAIN = 65_536  # bytes that are contracted one window after the other where two windows share no token

_CONTRACT = """
WITH RECURSIVE state(w, pos, tok, round) USING KEY (w, pos) AS (
  SELECT w, pos, tok, 0 FROM seed
  UNION ALL
  SELECT w, pos, CASE WHEN gone THEN -1 WHEN taken THEN merged ELSE tok END, round + 1 FROM (
    SELECT *, coalesce(lag(taken) OVER (PARTITION BY w ORDER BY pos), false) AS gone FROM (
      SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, island ORDER BY pos) % 2 = 1 AS taken FROM (
        SELECT *, idx - row_number() OVER (PARTITION BY w, hit ORDER BY pos) AS island FROM (
          SELECT *, coalesce(rank = least_rank, false) AS hit FROM (
            SELECT p.*, m.rank, m.merged, min(m.rank) OVER (PARTITION BY p.w) AS least_rank FROM (
              SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS next, row_number() OVER (PARTITION BY w ORDER BY pos) AS idx FROM state WHERE tok >= 0
            ) p LEFT JOIN merges m ON m.first = p.tok AND m.second = p.next
          ) WHERE least_rank IS NOT NULL
        )
      )
    )
  )
)
SELECT w, list(tok ORDER BY pos) AS ids FROM state WHERE tok >= 0 GROUP BY w ORDER BY w
"""


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder:
    """One worker's tokenizer: the merge table in an embedded database, and the ids of common words."""

    def __init__(self, name: str = "byte_bpe_50k", directory: str = DIRECTORY) -> None:
        import duckdb

        with open(os.path.join(directory, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        rows = [(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
        merges = pa.table({
            "first": pa.array([vocab[a] for a, _ in rows], pa.int32()),
            "second": pa.array([vocab[b] for _, b in rows], pa.int32()),
            "rank": pa.array(range(len(rows)), pa.int32()),
            "merged": pa.array([vocab[a + b] for a, b in rows], pa.int32()),
        })
        self.byte = np.zeros(256, np.int32)
        for c, b in _byte_characters().items():
            self.byte[b] = vocab[c]
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of a token
        for token, n in vocab.items():
            self.length[n] = len(token)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        self.db.register("merge_source", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_source")
        self.words = regex.compile(PATTERN)
        self.memo: dict[str, array] = {}

    def split(self, text: str) -> list[str]:
        return self.words.findall(text)

    def _contract(self, words: list[bytes]) -> list[array]:
        """Ids of byte strings, in batches of a bounded number of bytes."""
        out: list[array] = [array("i")] * len(words)
        todo: list[int] = []
        weight = 0
        for n in sorted(range(len(words)), key=lambda n: len(words[n])):
            if todo and weight + len(words[n]) > BATCH_BYTES:
                self._contract_batch(words, todo, out)
                todo, weight = [], 0
            todo.append(n)
            weight += len(words[n])
        if todo:
            self._contract_batch(words, todo, out)
        return out

    def _contract_batch(self, words: list[bytes], todo: list[int], out: list[array]) -> None:
        sizes = np.fromiter((len(words[n]) for n in todo), np.int32, len(todo))
        w = np.repeat(np.arange(len(todo), dtype=np.int32), sizes)
        pos = np.arange(len(w), dtype=np.int32) - np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, sizes)
        tok = self.byte[np.frombuffer(b"".join(words[n] for n in todo), np.uint8)]
        self.db.register("seed", pa.table({"w": w, "pos": pos, "tok": tok}))
        got = self.db.sql(_CONTRACT).to_arrow_table()
        self.db.unregister("seed")
        lists = got.column("ids").combine_chunks()
        values = lists.values.to_numpy(zero_copy_only=False).astype("int32")
        offsets = lists.offsets.to_numpy()
        for k, n in enumerate(todo):
            out[n] = array("i", values[offsets[k] : offsets[k + 1]].tobytes())

    def _ends(self, start: int, ids: array) -> np.ndarray:
        """Where each token ends."""
        return start + np.cumsum(self.length[np.frombuffer(ids, np.int32)])

    def _join(self, left: array, at: int, right: array, start: int) -> array | None:
        """``left`` (tokens from ``at`` on) continued by ``right`` (from ``start`` on) behind a token that both have."""
        a, b = self._ends(at, left), self._ends(start, right)
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        same = np.flatnonzero(np.frombuffer(left, np.int32)[i] == np.frombuffer(right, np.int32)[j])
        if not len(same):
            return None
        k = same[len(same) // 2]
        return left[: i[k] + 1] + right[j[k] + 1 :]

    def _long(self, words: list[bytes]) -> list[array]:
        """Ids of long byte strings by windows."""
        spans = [(n, s) for n, raw in enumerate(words) for s in range(0, max(1, len(raw) - WINDOW + STRIDE), STRIDE)]
        parts = self._contract([words[n][s : s + WINDOW] for n, s in spans])
        settled = [array("i") for _ in words]
        ids, begin, reach = array("i"), 0, 0  # tokens that aren't settled, and the bytes they stand for
        for (n, s), part in zip(spans, parts):
            size, end = len(words[n]), min(s + WINDOW, len(words[n]))
            if s == 0:
                ids, begin, reach = part, 0, end
            elif end <= reach:
                continue
            else:
                joined = self._join(ids, begin, part, s)
                if joined is None:
                    end = min(s + CHAIN, size)
                    joined = self._chain(words[n], ids, begin, end)
                if joined is None:  # the settled tokens are needed too
                    begin, joined = 0, self._chain(words[n], settled[n] + ids, 0, end)
                    settled[n] = array("i")
                ids, reach = joined, end
            ends = self._ends(begin, ids)
            keep = len(ids) if reach == size else int(np.searchsorted(ends, reach - WINDOW))
            settled[n].extend(ids[:keep])
            ids, begin = ids[keep:], int(ends[keep - 1]) if keep else begin
        return settled

    def _chain(self, raw: bytes, ids: array, begin: int, end: int) -> array | None:
        """``ids`` (tokens from ``begin`` on) carried on to ``end`` by windows that start at one of their tokens; None if they are too few."""
        width = WINDOW
        while True:
            ends = self._ends(begin, ids)
            if ends[-1] >= end:
                return ids
            k = int(np.searchsorted(ends, ends[-1] - width // 2)) - 1
            start = int(ends[k]) if k >= 0 else begin
            if start == begin > 0:
                return None
            (part,) = self._contract([raw[start : min(end, start + 8 * width)]])
            joined = part if start == 0 else self._join(ids, begin, part, start)
            if joined is not None:
                ids = joined
            if joined is None or start == 0:
                width *= 2

    def learn(self, words: set[str]) -> dict[str, array]:
        """Ids of words that aren't remembered; short ones are remembered from then on."""
        raw = {w: w.encode("utf-8") if w.isascii() else w.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode("utf-8") for w in words}
        out: dict[str, array] = {}
        for part, contract in (({w: r for w, r in raw.items() if len(r) <= WINDOW}, self._contract), ({w: r for w, r in raw.items() if len(r) > WINDOW}, self._long)):
            out.update(zip(part, contract(list(part.values()))))
        if len(self.memo) + len(out) > MEMO:
            self.memo.clear()
        self.memo.update((k, v) for k, v in out.items() if len(k) <= 64)
        return out

    def encode(self, texts: list[str | None]) -> list[array]:
        split = [self.split(t) if t else [] for t in texts]
        new = {w for words in split for w in words if w not in self.memo}
        fresh = self.learn(new) if new else {}
        memo = self.memo
        out = []
        for words in split:
            ids = array("i")
            for w in words:
                ids.extend(memo[w] if w in memo else fresh[w])
            out.append(ids)
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, directory: str) -> Encoder:
    """The worker's encoder, made once a process."""
    if (name, directory) not in _encoders:
        _encoders[name, directory] = Encoder(name, directory)
    return _encoders[name, directory]


def _encoded(documents: DataFrame, key: str, text: str, name: str, directory: str, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, directory)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                yield make(part.column(0), enc.encode(part.column(1).to_pylist()))

    return documents.select(key, text).mapInArrow(run, schema)


def _ids(keys: pa.Array, lists: list[array]) -> pa.RecordBatch:
    offsets = array("i", [0])
    values = array("i")
    for x in lists:
        values.extend(x)
        offsets.append(len(values))
    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
    return pa.RecordBatch.from_arrays([keys, ids], names=["doc_id", "ids"])


def _counts(keys: pa.Array, lists: list[array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, pa.array([len(x) for x in lists], pa.int64())], names=["doc_id", "tokens"])


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", directory: str = DIRECTORY) -> DataFrame:
    """``doc_id`` and ``ids`` of every row."""
    return _encoded(documents, key, text, name, directory, "doc_id bigint, ids array<int>", _ids)


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", directory: str = DIRECTORY) -> DataFrame:
    """``doc_id`` and ``tokens`` (how many) of every row."""
    return _encoded(documents, key, text, name, directory, "doc_id bigint, tokens bigint", _counts)


def decode(ids: list[int], name: str = "byte_bpe_50k", directory: str = DIRECTORY) -> str:
    """The text of ids."""
    with open(os.path.join(directory, f"{name}.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = {n: w for w, n in vocab.items()}
    byte = _byte_characters()
    return bytes(byte[c] for n in ids for c in words[n]).decode("utf-8", "replace")
