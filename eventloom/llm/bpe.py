"""Operator 6: byte-level BPE encoding and decoding.

A first pass over Arrow batches splits texts into pieces by the tokenizer's pattern and numbers the distinct pieces that a
task has met.  Spark higher-order functions then fold the ranked merges over the bytes of each new piece, looking pairs up
in a literal map, and turn ids back into binary pieces by a literal array.  A last pass, in the same task, keeps the ids and
bytes of the pieces by number and puts them in their places.  Texts travel in blocks, a row each, with the pieces that are
new in it; nothing is shuffled.  When a task has met MOST_PIECES pieces both sides forget them and go on, so memory is
bounded by that and by a block, whatever the size of a task.

In a fold, a token is the character whose code follows from its rank (see token), so that a piece is a string, a merge puts
one character in the place of two, and the least character of the possible merges is the one of the lowest rank.  Before
that, bytes are the characters U+0000 to U+00FF.  The literal map is an array of small maps, one per hash bucket, as a look-up in one large map
would scan it.

Cases: a null or empty text has no ids and decodes to no bytes.  A fold looks all pairs up for every merge, so its time
grows with the square of a piece's length; pieces of over LONG bytes are folded by a heap in the last pass instead, with the same
ids.  Texts of any length are whole.  Repeated rows are encoded each by itself.  Only the id and text columns are read, so
others may have any name.  An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tokenizer_path

#: White space as the Unicode property has it, in place of a library's own reading of \\s.
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SPACES = "".join(rf"\x{{{c:x}}}" for c in _WHITE)
WHITE = "".join(map(chr, _WHITE))
MARK = "\x1e"
#: Stands ahead of tokens that no merge is left for.  It is no token.
DONE = "\x00"
LONG = 256
BUCKETS = 1 << 17
BLOCK_BYTES = 1_000_000
MOST_PIECES = 250_000


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    import regex

    return regex.compile(pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall


def token(rank: int) -> str:
    """The character of a rank; characters have the order of ranks, and none is a surrogate."""
    return chr(rank + 1 if rank + 1 < 0xD800 else rank + 1 + 0x800)


def rank_of(character: Column) -> Column:
    code = F.ascii(character)
    return F.when(code < 0xD800, code - 1).otherwise(code - 1 - 0x800)


def hashed(entries: dict[str, object], kind: str) -> Column:
    """A literal array of maps: an entry stands in the map at its key's bucket."""
    buckets: list[dict | None] = [None] * BUCKETS
    for key, value in entries.items():
        k = xxhash.xxh64_intdigest(key.encode(), seed=42) % BUCKETS
        buckets[k] = (buckets[k] or {}) | {key: value}
    return F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{kind}>>")


def look_up(literal: Column, key: Column) -> Column:
    """Null without an entry.  BUCKETS is a power of two."""
    return F.get(literal, F.xxhash64(key).bitwiseAND(BUCKETS - 1).cast("int"))[key]


def last_merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merges leave of a piece just before they make it whole; none where they never do."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            return None
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 and parts[0] in ranks and parts[1] in ranks else None


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[bytes, bytes], bytes]:
    """Each token by the pair that merges to it.

    Of the pairs whose bytes together are a token, only one can ever stand side by side: as no merge has crossed the token's
    ends, those within have come in the order in which they come in the token alone.
    """
    return {pair: piece for piece in ranks if len(piece) > 1 and (pair := last_merge(piece, ranks)) is not None}


def merge_map(ranks: dict[bytes, int]) -> Column:
    """The token that a pair of tokens makes, for each pair that merges."""
    return hashed({token(ranks[a]) + token(ranks[b]): token(ranks[piece]) for (a, b), piece in merge_pairs(ranks).items()}, "string")


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, whatever the number of references to it."""
    return F.get(F.transform(F.array(value), f), 0)


def fold_merges(piece: Column, single: str, merges: Column, whole: Column) -> Column:
    """Ids of a piece, given as a string of bytes: the adjacent pair of the lowest rank is merged until none has a rank.

    single holds the tokens of the bytes 0 to 255, and whole the pieces that are tokens themselves.
    """

    def step(tokens: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(tokens) - 1), lambda i: F.substring(tokens, i, F.lit(2)))
        made = F.transform(pairs, lambda p: look_up(merges, p))
        put = lambda m: bind(F.array_min(m), lambda x: F.when(x.isNull(), F.concat(F.lit(DONE), tokens)).otherwise(F.overlay(tokens, x, F.array_position(m, x).cast("int"), F.lit(2))))
        return F.when((F.length(tokens) < 2) | F.startswith(tokens, F.lit(DONE)), tokens).otherwise(bind(made, put))

    start = F.translate(piece, "".join(map(chr, range(256))), single)
    folded = F.ltrim(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(piece) - 1, F.lit(1))), start, step), F.lit(DONE))
    return bind(look_up(whole, piece), lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(F.transform(F.split(folded, ""), rank_of)))


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """A literal array: the bytes of each id, as a string of bytes."""
    pieces: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def join_pieces(ids: Column, pieces: Column) -> Column:
    """The bytes of ids, as binary."""
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), "ISO-8859-1")


def fold_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a heap over linked parts, for pieces of any length."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or middle >= n or end[middle] != stop:
            continue
        alive[middle] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def number_pieces(texts, find: Callable[[str], list[str]], number: dict[str, int], known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of an Arrow array of strings' pieces, text by text, and the texts' offsets in them; new pieces are
    numbered on, and known keeps the numbers of a part's pieces.

    Texts are cut before each run of other characters and the one white space character ahead of it.  No piece of the
    pattern spans such a cut, so the pattern is applied to the distinct parts alone.  Texts that hold the mark
    themselves are split by the pattern as they are.
    """
    import pyarrow.compute as pc

    from .packing import gather

    marked = pc.match_substring(texts, MARK)
    parts = pc.split_pattern(pc.replace_substring_regex(pc.if_else(marked, "", texts), f"([{_SPACES}]?[^{_SPACES}]+)", MARK + r"\1"), MARK)
    coded = parts.flatten().dictionary_encode()
    flat, ends = [], [0]
    for part in coded.dictionary.to_pylist():
        if (numbers := known.get(part)) is None:
            numbers = known[part] = [number.setdefault(w, len(number)) for w in find(part)]
        flat += numbers
        ends.append(len(flat))
    at, offsets = gather(np.array(flat, np.int32), np.array(ends), coded.indices.to_numpy())
    offsets = offsets[parts.offsets.to_numpy()]
    if pc.any(marked).as_py():
        lists = np.split(at, offsets[1:-1])
        for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)):
            lists[i] = np.array([number.setdefault(w, len(number)) for w in find(texts[int(i)].as_py())], np.int32)
        at, offsets = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return at, offsets


def blocks_of(docs: DataFrame, pattern: str, block_bytes: int, most_pieces: int) -> DataFrame:
    """Rows of some documents each: ids, the pieces that the task has not numbered yet, and each document's pieces by number.

    first is the number of the first new piece; where it is 0, numbers start anew.  Pieces of over LONG bytes are set apart
    in long_pieces; in pieces an empty string stands for each.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        find, number, known = splitter(pattern), {}, {}
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            grown = np.cumsum(pc.binary_length(texts).to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(grown // block_bytes)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if len(number) >= most_pieces:
                    number, known = {}, {}
                first = len(number)
                at, offsets = number_pieces(texts[lo:hi], find, number, known)
                pieces = list(islice(reversed(number), len(number) - first))[::-1]
                is_long = [len(w) > LONG // 4 and len(w.encode()) > LONG for w in pieces]
                long = pa.array([w for w, x in zip(pieces, is_long, strict=True) if x], pa.string())
                short = pa.array(["" if x else w for w, x in zip(pieces, is_long, strict=True)], pa.string())
                use = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), one(batch.column(0)[lo:hi]), one(short), one(long), one(use)], names=["first", "doc_ids", "pieces", "long_pieces", "use"])

    return docs.mapInArrow(run, "first int, doc_ids array<long>, pieces array<string>, long_pieces array<string>, use array<array<int>>")


def encode(docs: DataFrame, make_row: Callable, schema: str, vocabulary: str | None = None, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES, most_pieces: int = MOST_PIECES) -> DataFrame:
    """make_row(doc_id, list of numbers of pieces, ids by piece, decoded bytes by piece) for every document."""
    import public_tokenizers
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    path, pattern = vocabulary or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    ranks = read_ranks(path)
    blocks = blocks_of(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), pattern, block_bytes, most_pieces)
    single = "".join(token(ranks[bytes([b])]) for b in range(256))
    merges, whole, pieces = merge_map(ranks), hashed({p.decode("latin-1"): r for p, r in ranks.items()}, "int"), piece_literal(ranks)
    blocks = blocks.withColumn("ids", F.transform("pieces", lambda w: fold_merges(F.decode(F.encode(w, "UTF-8"), "ISO-8859-1"), single, merges, whole)))
    blocks = blocks.select("first", "doc_ids", "pieces", "long_pieces", "use", "ids", F.transform("ids", lambda x: join_pieces(x, pieces)).alias("bytes"))
    blocks = blocks.select("first", "doc_ids", F.transform("pieces", lambda w: w == "").alias("is_long"), "long_pieces", "use", "ids", "bytes")
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, raw = [], []  # by piece: ids in decimal, and bytes
        for batch in batches:
            for block in range(batch.num_rows):
                if batch.column(0)[block].as_py() == 0:
                    ids, raw = [], []
                doc_ids, is_long, long, use, new, new_raw = (c[block].values for c in batch.columns[1:])
                at = len(ids)
                start = new.offsets.to_numpy()
                decimals = pa.ListArray.from_arrays(pa.array(start - start[0]), pc.cast(new.flatten(), pa.string()))
                ids += pc.binary_join(decimals, " ").to_pylist()
                raw += new_raw.to_pylist()
                for i, w in zip(np.flatnonzero(is_long.to_numpy(zero_copy_only=False)), long.to_pylist(), strict=True):
                    found, by_id = fold_long(w.encode(), read_ranks(path)), tokens_by_id(path)
                    ids[at + i], raw[at + i] = " ".join(map(str, found)), b"".join([by_id[x] for x in found])
                flat, offsets = use.flatten().to_numpy(), use.offsets.to_numpy() - use.offsets[0].as_py()
                rows = [make_row(doc, flat[a:b].tolist(), ids, raw) for doc, a, b in zip(doc_ids.to_pylist(), offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    return blocks.mapInArrow(run, schema)


@cache
def tokens_by_id(path: str) -> dict[int, bytes]:
    return {v: k for k, v in read_ranks(path).items()}


def _ids_row(doc, at, ids, raw):
    return doc, [int(x) for i in at for x in ids[i].split()]


def _digest_row(doc, at, ids, raw):
    text = " ".join(map(ids.__getitem__, at))
    n = text.count(" ") + 1 if at else 0
    return doc, n, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b"".join(map(raw.__getitem__, at))).hexdigest()


def encode_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, ids): the ids of every whole text."""
    return encode(docs, _ids_row, "doc_id long, ids array<int>", **options)


def decode_documents(coded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, bytes): what the column ids decodes to, by higher-order functions alone."""
    ranks = read_ranks(vocabulary or tokenizer_path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", join_pieces(F.col("ids"), piece_literal(ranks)).alias("bytes"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), _digest_row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
