"""Alignment of two tokenizers over the same bytes, and how often their tokens meet.

The tokens of both sides are the nodes of a bipartite graph; an edge joins an A
token and a B token that overlap. Along the bytes every edge is the stretch
between two neighbouring token ends, and edges that share a token are
neighbours, so union-find needs one union an edge, with the edge before it: the
parent of an edge is the one before or itself, and all roots come from one running
maximum. Components are exactly the minimal groups of tokens that cover the
same bytes.

All A-B pairs of a component are links. Documents are read in blocks of about
``BLOCK_BYTES`` of text: a block has rows with its distinct linked id pairs (at most
``ROW_PAIRS`` in one) and in how many of its documents each occurs, and a row a document
with which of them it holds and how often. So a pair is counted over the corpus by rows
(block, pair), the counts return to the blocks by a join on the pair, and each block
sums up its own documents. Nothing of the corpus goes to the driver or to all tasks; a
pair has one row a block however many documents link it. No row holds more than a
document or ``ROW_PAIRS`` pairs, as readers and writers of Parquet hold many rows at once.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinmill.llm.packing import _byte_of, encoder
from skeinmill.runtime import discard, settle, table, text_batches

#: Bytes of text after which a block is closed, and those worked on at a time.
BLOCK_BYTES, CHUNK_BYTES = 1 << 22, 1 << 19

#: Distinct pairs of a block in one row.
ROW_PAIRS = 1 << 13

#: A component with more links than this is expanded over its distinct ids.
MANY_LINKS = 1 << 12

_COMMA, _BAR, _SEMICOLON = b",|;"


class _Side:
    """One tokenizer: ids of a text, and the bytes that each id stands for."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)

    def covers(self, ids: np.ndarray, text: bytes) -> bool:
        """Whether the ids' bytes are those of ``text``."""
        return int(self.lengths[ids].sum()) == len(text) and b"".join([self.pieces[i] for i in ids.tolist()]) == text


class ByteSide(_Side):
    """A byte-level BPE file of the tokenizers library, over the text with a space before it."""

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of, pieces = _byte_of(), [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        super().__init__(pieces)
        self._encode = encoder(path).ordinary

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [self._encode(" " + t).astype(np.int64) for t in texts]


class PieceSide(_Side):
    """A sentencepiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        super().__init__([bytes([int(p[1:-1], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self._model.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=1)
def _sides(a: str, b: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(a), PieceSide(b)


@functools.lru_cache(maxsize=1)
def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to size - 1 as rows of bytes with room for one more, and their lengths."""
    names = np.array([str(i) for i in range(size)], dtype="S")
    width = names.dtype.itemsize
    rows = np.zeros((size, width + 1), np.uint8)
    rows[:, :width] = names.view(np.uint8).reshape(size, width)
    return rows, np.char.str_len(names).astype(np.int64)


def minimal_groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Component numbers of the A tokens and of the B tokens that end at these offsets (rising, over the same bytes), and how many there are."""
    if not len(end_a):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    is_a, is_b = np.zeros(int(end_a[-1]) + 1, bool), np.zeros(int(end_a[-1]) + 1, bool)
    is_a[end_a], is_b[end_b] = True, True
    place = np.flatnonzero(is_a | is_b)  # one edge ends at each
    of_a = np.cumsum(is_a)[place] - is_a[place]
    of_b = np.cumsum(is_b)[place] - is_b[place]
    edge = np.arange(len(place))
    apart = np.ones(len(place), bool)
    apart[1:] = (of_a[1:] != of_a[:-1]) & (of_b[1:] != of_b[:-1])
    root = np.maximum.accumulate(np.where(apart, edge, 0))
    number = (np.cumsum(apart) - 1)[root]
    return number[is_a[place]], number[is_b[place]], int(apart.sum())


def _written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2;`` of all groups as bytes, and where the text of each group ends."""
    upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
    at_a = np.arange(len(a)) + (upto_b - n_b)[group_a]
    at_b = np.arange(len(b)) + upto_a[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), _COMMA, np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[upto_a - 1]], mark[at_b[upto_b - 1]] = _BAR, _SEMICOLON
    rows, length = _digits(size)
    cells, n = rows[ids], length[ids]
    cells[np.arange(len(ids)), n] = mark
    return cells[np.arange(cells.shape[1]) <= n[:, None]], np.cumsum(n + 1)[(upto_a + upto_b) - 1]


def _links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, A id, B id, how often) of all links; long components give each pair of ids once."""
    start_a, start_b, total = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    small = np.flatnonzero(total <= MANY_LINKS)
    group = np.repeat(small, total[small])
    nth = np.arange(len(group)) - np.repeat(np.cumsum(total[small]) - total[small], total[small])
    parts = [(group, a[start_a[group] + nth // n_b[group]], b[start_b[group] + nth % n_b[group]], np.ones(len(group), np.int64))]
    for g in np.flatnonzero(total > MANY_LINKS):
        ua, ca = np.unique(a[start_a[g] : start_a[g] + n_a[g]], return_counts=True)
        ub, cb = np.unique(b[start_b[g] : start_b[g] + n_b[g]], return_counts=True)
        parts.append((np.full(len(ua) * len(ub), g), np.repeat(ua, len(ub)), np.tile(ub, len(ua)), np.outer(ca, cb).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class _Block:
    """Documents of one block: per document its id and figures, and its distinct pairs with how often it links them."""

    FIGURES = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self, stride: int, keep_groups: bool):
        self.stride, self.keep_groups, self.bytes = stride, keep_groups, 0
        self.ids: list[pa.Array] = []
        self.figures: list[np.ndarray] = []
        self.sha: list[str] = []
        self.groups: list[str] = []
        self.pairs: list[np.ndarray] = []
        self.often: list[np.ndarray] = []
        self.held: list[np.ndarray] = []

    def add(self, ids: pa.Array, texts: list[str | None], sides: tuple[_Side, _Side]) -> None:
        side_a, side_b = sides
        raw = [(" " + t).encode() if t else b"" for t in texts]
        found_a = iter(side_a.ids([t for t in texts if t]))
        found_b = iter(side_b.ids([t for t in texts if t]))
        a, b = [], []
        for text in raw:
            x, y = (next(found_a), next(found_b)) if text else (np.empty(0, np.int64),) * 2
            if text and not (side_a.covers(x, text) and side_b.covers(y, text)):
                x = y = np.empty(0, np.int64)
            a.append(x)
            b.append(y)
        doc_a, doc_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        a, b = np.concatenate(a), np.concatenate(b)
        group_a, group_b, n = minimal_groups(np.cumsum(side_a.lengths[a]), np.cumsum(side_b.lengths[b]))
        n_a, n_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        # groups before the end of each document; a document ends where tokens of both sides end
        upto = np.concatenate([[0], group_a + 1])[np.cumsum(doc_a)] if n else np.zeros(len(texts), np.int64)
        first = np.concatenate([[0], upto[:-1]])
        doc_of = np.repeat(np.arange(len(texts)), upto - first)
        n_links = np.bincount(doc_of, weights=(n_a * n_b).astype(np.float64), minlength=len(texts)).astype(np.int64)
        self.figures.append(np.stack([doc_a, doc_b, upto - first, n_links]))
        self.ids.append(ids)
        text, ends = _written(a, b, group_a, group_b, n_a, n_b, max(len(side_a.pieces), len(side_b.pieces))) if n else (np.empty(0, np.uint8), np.empty(0, np.int64))
        for i in range(len(texts)):
            own = text[ends[first[i] - 1] if first[i] else 0 : ends[upto[i] - 1] - 1].tobytes() if upto[i] > first[i] else b""
            self.sha.append(hashlib.sha256(own).hexdigest() if own else "")
            if self.keep_groups:
                self.groups.append(own.decode())
        g, x, y, often = _links(a, b, n_a, n_b)
        size = len(side_b.pieces)
        key, back = np.unique(doc_of[g] * (len(side_a.pieces) * size) + x * size + y, return_inverse=True)
        self.often.append(np.bincount(back, weights=often.astype(np.float64), minlength=len(key)).astype(np.int64))
        self.pairs.append(key % (len(side_a.pieces) * size))
        self.held.append(np.bincount(key // (len(side_a.pieces) * size), minlength=len(texts)))
        self.bytes += sum(map(len, raw))

    def rows(self, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row a document, and rows with the pairs from number ``first`` on."""
        pairs, which = np.unique(np.concatenate(self.pairs), return_inverse=True)
        held = np.concatenate([[0], np.cumsum(np.concatenate(self.held))]).astype(np.int32)
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        docs = {"id": pa.concat_arrays(self.ids), "sha": pa.array(self.sha, pa.string()), "groups": pa.array(self.groups or [None] * len(self.sha), pa.string())}
        docs |= {k: pa.array(v) for k, v in zip(self.FIGURES, np.concatenate(self.figures, axis=1), strict=True)}
        docs |= {"which": lists(held, which.astype(np.int32)), "often": lists(held, np.concatenate(self.often))}
        ends = np.append(np.arange(0, len(pairs), ROW_PAIRS), len(pairs))
        found = {"first": pa.array(ends[:-1].astype(np.int64)), "pairs": lists(ends, pairs), "docs": lists(ends, np.bincount(which, minlength=len(pairs)).astype(np.int64))}
        for own, n in ((docs, len(self.sha)), (found, len(ends) - 1)):
            own["block"] = pa.array(np.full(n, block))
            yield pa.record_batch([own[f.name].cast(f.type) if f.name in own else pa.nulls(n, f.type) for f in schema], schema=schema)


def _block_schema(id_type: T.DataType) -> T.StructType:
    kinds = {"block": T.LongType(), "id": id_type, "sha": T.StringType()} | {k: T.LongType() for k in _Block.FIGURES} | {"groups": T.StringType()}
    kinds |= {"which": T.ArrayType(T.IntegerType()), "often": T.ArrayType(T.LongType())}
    kinds |= {"first": T.LongType(), "pairs": T.ArrayType(T.LongType()), "docs": T.ArrayType(T.LongType())}
    return T.StructType([T.StructField(k, t) for k, t in kinds.items()])


def _aligner(path_a: str, path_b: str, keep_groups: bool, schema: T.StructType):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        sides = _sides(path_a, path_b)
        new = lambda: _Block(len(sides[1].pieces), keep_groups)
        block, count = new(), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end] or "") <= CHUNK_BYTES):
                    held += len(texts[end] or "")
                    end += 1
                block.add(batch.column(0).slice(at, end - at), texts[at:end], sides)
                at = end
                if block.bytes >= BLOCK_BYTES:
                    yield from block.rows(count, arrow)
                    block, count = new(), count + 1
        if block.ids:
            yield from block.rows(count, arrow)

    return align


def aligned_blocks(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """A table of blocks: what ``pair_counts`` and ``align_tokens`` read."""
    schema = _block_schema(docs.schema[id_col].dataType)
    with text_batches(docs.sparkSession):
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        return settle(rows.mapInArrow(_aligner(tokenizer_a, tokenizer_b, keep_groups, schema), schema), "token-blocks")


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, b, n, best): in how many documents each pair of ids is linked, and whether no other B id has more with its A id."""
    each = blocks.where("first IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("x.*")
    n = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n"))
    most = F.max("n").over(W.partitionBy("a"))  # no more rows than B has ids
    return n.select("pair", F.expr(f"pair div {size_b}").alias("a"), F.expr(f"pair % {size_b}").alias("b"), "n").withColumn("best", F.col("n") == most)


def _summer(id_name: str, schema: T.StructType):
    """Per document of a block: links whose pair is best, and the sum of all links' counts. ``met`` has the block's pairs by number."""

    def add(docs: pa.Table, met: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        lists = lambda name: docs.column(name).combine_chunks()
        which, often = lists("which").flatten().to_numpy(), lists("often").flatten().to_numpy()
        upto = np.cumsum(lists("which").value_lengths().to_numpy())
        held = np.diff(upto, prepend=0)
        at, size = met.column("i").to_numpy(), int(which.max(initial=-1)) + 1
        n, best = np.zeros(size, np.int64), np.zeros(size, bool)
        n[at], best[at] = met.column("n").to_numpy(), met.column("best").to_numpy()
        total = lambda x: (t := np.concatenate([[0], np.cumsum(x)]))[upto] - t[upto - held]
        sums = {"n_best": pa.array(total(often * best[which])), "count_sum": pa.array(total(often * n[which]))}
        arrow = to_arrow_schema(schema)
        columns = [sums[f.name] if f.name in sums else docs.column("id" if f.name == id_name else f.name) for f in arrow]
        return pa.table([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return add


def align_tokens(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha, groups.

    ``groups`` (with ``keep_groups``, else null) writes the minimal groups as
    ``a1,a2|b1;a3|b2``; ``sha`` is its SHA-256, empty without tokens. Null and
    empty texts, and texts whose bytes a tokenizer changes, have no tokens and
    zeros. Repeated rows are documents of their own; an empty table gives an
    empty result; other columns are not read.
    """
    blocks = aligned_blocks(docs, tokenizer_a, tokenizer_b, id_col, text_col, keep_groups)
    size_b = len(_sides(tokenizer_a, tokenizer_b)[1].pieces)
    counts = settle(pair_counts(blocks, size_b).select("pair", "n", "best"), "token-pairs")
    each = blocks.where("first IS NOT NULL").select("block", "first", F.posexplode("pairs").alias("j", "pair"))
    met = each.select("block", (F.col("first") + F.col("j")).alias("i"), "pair").join(counts, "pair").select(F.col("block").alias("of"), "i", "n", "best")
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType)]
        + [T.StructField(k, T.LongType()) for k in (*_Block.FIGURES, "n_best", "count_sum")] + [T.StructField("sha", T.StringType()), T.StructField("groups", T.StringType())]
    )
    own = blocks.where("first IS NULL").drop("first", "pairs", "docs")
    out = settle(own.groupBy("block").cogroup(met.groupBy("of")).applyInArrow(_summer("id", schema), schema), "token-alignment")
    discard(blocks)
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("sha").alias("groups_sha256"))


#: Tokenizers have no SQL; the tests hold a plain version against it.
ORACLE = None
