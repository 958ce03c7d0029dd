"""Duplicate chunks inside one document: exact, shadowed by a later chunk, and near.

A document's chunks are a list in its row, so it is judged by itself and nothing
is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.runtime import table

ESCAPED = re.compile(r"\\([\\`*_{}\[\]()#+\-.!|>~])")  # fixed value: what Markdown escapes
HEADING_ONLY = re.compile(r"^#{1,6}\s+(.+?)\s*$")
Chunk = tuple[str, str]  # text, title


def normalised(text: str | None) -> str:
    return " ".join(ESCAPED.sub(r"\1", (text or "").strip()).split())


def heading_title(text: str) -> str | None:
    """The title of a chunk that is one heading and nothing else."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    found = HEADING_ONLY.match(lines[0]) if len(lines) == 1 else None
    return found[1].strip() if found else None


def without_repeats(chunks: list[Chunk], short: int = 30) -> list[int]:
    """Numbers of the chunks that stay: not blank, not equal to an earlier one, and, if short or only a heading, not
    shadowed by any later one: with the same title, opening with that title as ``##`` heading, or (for short ones) longer
    and holding the text."""
    norms = [normalised(t) for t, _ in chunks]
    last_of = {title.strip(): i for i, (_, title) in enumerate(chunks) if norms[i]}
    headed = [(i, n) for i, n in enumerate(norms) if n.startswith("## ")]
    seen: set[str] = set()
    kept = []
    for i, (text, title) in enumerate(chunks):
        own, is_short, heading = norms[i], len(norms[i]) < short, heading_title(text or "")
        if not own or own in seen:
            continue
        seen.add(own)
        name = title.strip() or heading or ""
        shadowed = (is_short or heading is not None) and (
            (name != "" and (last_of.get(name, -1) > i or any(j > i and n.startswith(f"## {name}") for j, n in headed)))
            or (is_short and any(len(n) > len(own) and own in n for n in norms[i + 1 :]))
        )
        if not shadowed:
            kept.append(i)
    return kept


def features(text: str) -> set:
    """Pairs of neighbouring tokens (words; pairs of characters where words are not parted), or the tokens if there is one."""
    tokens = [t for run in re.findall(r"[一-鿿]+|[^\W_]+", text.lower()) for t in ([run[i : i + 2] for i in range(len(run) - 1)] if "一" <= run[0] <= "鿿" else [run]) if len(t) > 1]
    return set(zip(tokens, tokens[1:], strict=False)) or set(tokens)


def without_near_repeats(chunks: list[Chunk], least_chars: int = 80, threshold: float = 0.9, same_title: bool = True) -> list[int]:
    """Numbers of the chunks that stay: of two alike (exact Jaccard, of one title) the shorter goes, the later on a tie.
    A chunk's title is its own or its first line; a chunk that has gone while it is compared still removes others."""
    title = lambda c: c[1].strip() or (c[0].strip().splitlines() or [""])[0].lstrip("#").strip()
    groups: dict[str, list[int]] = {}
    for i, c in enumerate(chunks):
        if len((c[0] or "").strip()) >= least_chars:
            groups.setdefault(title(c) if same_title else "", []).append(i)
    gone: set[int] = set()
    for group in groups.values():
        sets = {i: features(chunks[i][0]) for i in group}
        for at, i in enumerate(group):
            if i in gone or not sets[i]:
                continue
            for j in group[at + 1 :]:
                small, big = sorted((len(sets[i]), len(sets[j])))
                if j not in gone and small >= threshold * big and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                    gone.add(i if len(chunks[i][0]) < len(chunks[j][0]) else j)
    return [i for i in range(len(chunks)) if i not in gone]


def kept_chunks(chunks: list[Chunk], near: bool = True, short: int = 30) -> list[int]:
    first = without_repeats(chunks, short)
    return [first[i] for i in without_near_repeats([chunks[i] for i in first])] if near else first


def dedup_document_chunks(docs: DataFrame, near: bool = True, short: int = 30) -> DataFrame:
    """doc_id, chunk_index (dense), from_index, text, title, token_count of the chunks that stay in documents (doc_id,
    chunks: array of text and title). A null list has none; null texts are blank; repeated ids are rows of their own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "chunk_index", "from_index", "text", "title", "token_count"]
        for frame in frames:
            rows = []
            for doc, listed in zip(frame["doc_id"], frame["chunks"], strict=True):
                chunks = [(c["text"] or "", c["title"] or "") for c in (listed if listed is not None else [])]
                rows += [(doc, n, i, *chunks[i], len(chunks[i][0])) for n, i in enumerate(kept_chunks(chunks, near, short))]
            yield pd.DataFrame(rows, columns=names)

    return docs.selectExpr("cast(doc_id as string) doc_id", "chunks").mapInPandas(run, "doc_id string, chunk_index int, from_index int, text string, title string, token_count int")


def dedup_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks, without the near ones."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("text"), F.lit("").alias("title")))
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("chunks"))
    return dedup_document_chunks(docs, near=False).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("chunks"), F.sum("from_index").alias("places"))


_NORM = r"trim(regexp_replace(regexp_replace(text, '\\([\\`*_{}\[\]()#+\-.!|>~])', '\1', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ')"
QUERIES = {
    "dedup_short_contained": (dedup_contained, rf"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
        n AS (SELECT doc_id, i, {_NORM} AS n, regexp_extract(trim(text, ' ' || chr(9) || chr(13)), '^#{{1,6}}\s+(.+?)\s*$', 1) AS h FROM l WHERE trim(text, ' ' || chr(9) || chr(13)) <> ''),
        f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY i) = 1),
        hit AS (SELECT DISTINCT a.doc_id, a.i FROM f a JOIN n b ON a.doc_id = b.doc_id AND b.i > a.i
          AND ((a.h <> '' AND starts_with(b.n, '## ' || a.h)) OR (length(a.n) < 30 AND length(b.n) > length(a.n) AND contains(b.n, a.n))))
        SELECT doc_id, count(*) AS chunks, sum(i)::BIGINT AS places FROM f ANTI JOIN hit USING (doc_id, i) GROUP BY 1"""),
}
