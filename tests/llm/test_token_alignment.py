import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skeinmill.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_tokens(texts):
    """Ids and bytes of both sides by the libraries themselves."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}
    for text in texts:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        raw_a = [bytes(byte_of[c] for c in tok.id_to_token(i)) for i in a]
        names = [sp.id_to_piece(i) for i in b]
        raw_b = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names, strict=True)]
        whole = (" " + text).encode() if text else b""
        yield (a, raw_a, b, raw_b) if b"".join(raw_a) == whole == b"".join(raw_b) else ([], [], [], [])


def plain_groups(a, raw_a, b, raw_b):
    """Two pointers: a group ends where both sides have read as many bytes."""
    groups, i, j = [], 0, 0
    while i < len(a):
        x, y, n, m = [a[i]], [b[j]], len(raw_a[i]), len(raw_b[j])
        i, j = i + 1, j + 1
        while n != m:
            if n < m:
                x.append(a[i])
                n += len(raw_a[i])
                i += 1
            else:
                y.append(b[j])
                m += len(raw_b[j])
                j += 1
        groups.append((x, y))
    return groups


def plain(texts):
    found = [plain_groups(*t) for t in plain_tokens(texts)]
    links = [Counter((x, y) for g in groups for x in g[0] for y in g[1]) for groups in found]
    count = Counter(pair for doc in links for pair in doc)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    for groups, doc in zip(found, links, strict=True):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(doc.values()),
            sum(n for p, n in doc.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in doc.items()),
            written, hashlib.sha256(written.encode()).hexdigest() if written else "",
        )


ODD = [
    "plain words and the other words", "plain words and the other words", "", None, " ", "  two  spaces\tand tabs\n\nlines ", "café naïve 中文字 да", "\U0001f600\U0001f468‍\U0001f469 x",
    "<|endoftext|> and <s> are text", "a▁b", "\x00\x01 control", "x" * 700, " " * 3000, "你好" * 300, "é ﬁ ½", "1234567890 3.14159", " line　wide",
]


def rows(df):
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "sha")) for r in df.collect()]


@pytest.mark.parametrize(("block", "many"), [(1 << 22, 1 << 12), (300, 3)])
def test_matches_a_plain_version(spark, monkeypatch, block, many):
    monkeypatch.setattr(ta, "BLOCK_BYTES", block)
    monkeypatch.setattr(ta, "MANY_LINKS", many)
    rng = np.random.default_rng(5)
    letters = list("abcde é中\n.")
    texts = ODD + ["".join(rng.choice(letters, rng.integers(1, 200))) for _ in range(60)]
    docs = spark.createDataFrame([(f"d{i}", t, 1, "x") for i, t in enumerate(texts)], "doc_id string, text string, block int, `odd name:x` string").repartition(3)
    got = {r.doc_id: r for r in ta.align_tokens(docs, A, B, keep_groups=True).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain(texts)):
        r = got[f"d{i}"]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups, r.sha) == (*want[:6], want[6], want[7]), texts[i]


def test_empty_tables_null_and_repeated_ids(spark):
    schema = "doc_id long, text string"
    assert ta.align_tokens(spark.createDataFrame([], schema), A, B).count() == 0
    texts = ["same text", "same text", None, "", "other"]
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (3, None), (3, ""), (4, "other")], schema)
    got = ta.align_tokens(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha", "groups"]
    assert sorted(r[:6] + r[7:] for r in plain(texts)) == sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.sha) for r in got.collect())


def test_components_of_offsets():
    group_a, group_b, n = ta.minimal_groups(np.array([2, 4, 5, 9]), np.array([1, 2, 5, 7, 8, 9]))
    assert (group_a.tolist(), group_b.tolist(), n) == ([0, 1, 1, 2], [0, 0, 1, 2, 2, 2], 3)


def test_query_on_the_small_table(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: (*w[:6], w[7]) for d, w in zip(docs, plain([d.text for d in docs]), strict=True)}
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in ta.query(spark, data).collect()}
    assert got == want


def test_no_row_holds_a_block(spark, monkeypatch):
    texts = [(i, f"some text {i} with more words, n. {i * i}" * 3) for i in range(50)]
    blocks = ta.aligned_blocks(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), A, B)
    assert blocks.select("block").distinct().count() == 1
    docs = blocks.where("first IS NULL")
    assert docs.count() == 50 and sorted(r.id for r in docs.select("id").collect()) == list(range(50))
    assert blocks.selectExpr("max(size(pairs)) AS n").first().n <= ta.ROW_PAIRS
