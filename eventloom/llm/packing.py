"""Operator 5: cost-balanced packing of token sequences.

Each task packs its own documents in groups of bounded size, so nothing is shuffled.  In a group, the cost of a piece is
estimated as alpha * length + beta * length**2 (projections and attention).  Whole windows of long documents are
sequences of their own; what remains is assigned in descending length to the sequence of the lowest cost that still has
room, and is cut only where no sequence has room for all of it.  The sequences' capacities add up to exactly the group's
tokens, so at most one sequence a group is not full.

Cases: a null or empty text has the one token 1.  Very long texts are cut into windows.  Ties in length are packed in
order of (doc_id, arrival), rows without a doc_id last; repeated rows are packed each by itself.  Only the id and text columns are read, so others
may have any name.  An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table, tokenizer_path

END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
#: What plain texts don't have: anything but printable Latin-1 and common white space.
_ODD = r"[^\t-\r -~\x{a1}-\x{ac}\x{ae}-\x{ff}]"
#: The tokenizer file's own split of a lower-cased text, but for white space.
_PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"


def gather(flat: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists flat[offsets[i]:offsets[i + 1]] for i in at, one after the other, with their offsets."""
    sizes = (offsets[1:] - offsets[:-1])[at]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(offsets[at] - ends[:-1], sizes) + np.arange(ends[-1])], ends


class WordEncoder:
    """Ids of texts by a tokenizer file, each distinct word being encoded once.

    Texts of plain Latin-1 are lower-cased and split as the file's own rules do; any other text goes through the
    tokenizer as a whole.  New words are encoded many at a time: only a word's last id ends a word, so that the ids of
    words that stand in one string can be told apart.
    """

    def __init__(self, path: str, most_words: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merger = Tokenizer.from_file(path)  # for words that are normalised and split already
        self.merger.encode_special_tokens = True
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if hasattr(self.merger.model, "_resize_cache"):
            self.merger.model._resize_cache(0)  # new words only: its cache would never be hit
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.most_words = most_words

    def learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            ids = np.array(self.merger.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(stops) == len(part):
                raw = ids.tobytes()
                self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *stops], stops)), strict=True))
            else:
                for w in part:
                    self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct words."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most_words:  # a bound on memory; what is forgotten is encoded again
            self.known.clear()
            new = words
        self.learn(new)
        raw = list(map(self.known.__getitem__, words))
        return np.frombuffer(b"".join(raw), "<u4"), np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // 4)])

    def chunks(self, chunks) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of an Arrow array of distinct strings without white space."""
        import pyarrow.compute as pc

        pieces = pc.utf8_split_whitespace(pc.utf8_rtrim_whitespace(pc.replace_substring_regex(chunks, _PIECE, r"\1 ")))
        coded = pieces.flatten().dictionary_encode()
        flat, ends = gather(*self.words(coded.dictionary.to_pylist()), coded.indices.to_numpy())
        return flat, ends[pieces.offsets.to_numpy()]

    def encode(self, texts) -> list[np.ndarray]:
        """Ids, with the end's, of an Arrow array of strings without nulls."""
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, _ODD)
        split = pc.utf8_split_whitespace(pc.utf8_lower(texts.filter(pc.invert(odd))))
        coded = split.flatten().dictionary_encode()
        flat, ends = gather(*self.chunks(coded.dictionary), coded.indices.to_numpy())
        stops = iter(ends[split.offsets.to_numpy()].tolist())
        start, end, out = next(stops), np.array([END_ID], "<u4"), []
        for i, is_odd in enumerate(odd.to_pylist()):
            if is_odd:
                ids = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
            else:
                stop = next(stops)
                ids, start = flat[start:stop], stop
            out.append(np.concatenate([ids, end]))
        return out


@cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process."""
    return WordEncoder(path)


def pack(docs: list[tuple[int | None, np.ndarray]], capacity: int, alpha: float, beta: float) -> list[tuple[int, int, int, int, int, float]]:
    """Pieces (index of the document, start, length, sequence, offset, sequence's cost)."""
    cost_of = lambda n: alpha * n + beta * n * n
    pieces: list[list] = []
    n_full = 0
    left: list[tuple[int, int, int]] = []
    costs: list[float] = []
    for k, (_, ids) in enumerate(docs):
        whole = len(ids) // capacity
        for j in range(whole):
            pieces.append([k, j * capacity, capacity, n_full, 0])
            costs.append(cost_of(capacity))
            n_full += 1
        if len(ids) % capacity:
            left.append((k, whole * capacity, len(ids) % capacity))
    total = sum(n for *_, n in left)
    if total:
        left.sort(key=lambda x: (-x[2], docs[x[0]][0] is None, docs[x[0]][0] or 0, x[0]))
        n_seq = -(-total // capacity)
        room = np.full(n_seq, capacity)
        room[-1] = total - capacity * (n_seq - 1)
        size, cost = room.copy(), np.zeros(n_seq)
        for k, start, n in left:
            while n:
                fits = room >= n
                if fits.any():
                    s, take = int(np.where(fits, cost, np.inf).argmin()), n
                else:
                    s = int(np.where(room > 0, cost, np.inf).argmin())
                    take = int(room[s])
                pieces.append([k, start, take, n_full + s, int(size[s] - room[s])])
                room[s] -= take
                cost[s] += cost_of(take)
                start, n = start + take, n - take
        costs += cost.tolist()
    return [(*p, costs[p[3]]) for p in pieces]


def pack_sequences(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, alpha: float = 1.0, beta: float = 1.0 / 6144, group_docs: int = 4096, group_tokens: int = 2_000_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence, with a checksum of its ids.

    A sequence's number is the task's number times 2**33 plus a count, so numbers are unique without any exchange.
    alpha and beta weigh the linear and the quadratic part of a piece's cost.  A group is closed at group_docs documents
    or group_tokens tokens, whichever comes first; that bounds a task's memory and costs one unfilled sequence a group.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        encoder = word_encoder(path)
        base = TaskContext.get().partitionId() << 33
        held: list[tuple[int, np.ndarray]] = []
        tokens = 0

        def flush():
            nonlocal base, held, tokens
            rows = pack(held, capacity, alpha, beta)
            k, start, length, seq, offset, cost = zip(*rows, strict=True)
            crc = [zlib.crc32(held[i][1][s : s + n].tobytes()) for i, s, n in zip(k, start, length, strict=True)]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[i][0] for i in k], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array([len(held[i][1]) for i in k], pa.int64()), pa.array([base + s for s in seq], pa.int64()), pa.array(offset, pa.int64()), pa.array(cost, pa.float64()),
                ],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )
            base += max(seq) + 1
            held, tokens = [], 0
            return out

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(ids), 2048):
                for doc, got in zip(ids[i : i + 2048], encoder.encode(pc.fill_null(texts[i : i + 2048], "")), strict=True):
                    held.append((doc, got))
                    tokens += len(got)
                    if len(held) >= group_docs or tokens >= group_tokens:
                        yield flush()
        if held:
            yield flush()

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)


def op5_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"))
