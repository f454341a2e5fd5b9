"""Alignment of two tokenizers against every link of every document, one by one."""

import random
import string
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from emberline.llm import alignment, tokens
from emberline.llm import queries as q

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "a", "  x", "x  ", "\n", "a\nb", "a\n\nb", "a \n b", "日本語 テキスト", "a▁b", "a ▁ b c", "ﬁ x", "<|endoftext|> <s> </s> <unk>", "x\tb", "a b c", "a  b", "\x00a", "a \x1c b", "a\u0085 b",
    "don't it's we'll", "🎉🎉 x", "x" * 5000, "ab " * 3000, "é" * 300, "é a", "a\r\nb", "1234 56 7,8", "<0x0A> hi", "﻿abc", "the the the", "the the the", "".join(chr(c) for c in range(0x4E00, 0x4F00)), string.printable,
]


def texts_of(pieces, b):
    return [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text: all links of all documents, by hand."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    grouped, documents = [], defaultdict(set)
    for number, text in enumerate(texts):
        groups = None
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a, bytes_b = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a], texts_of([(i, b.id_to_piece(i)) for i in ids_b], b)
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = []
                for parts in (bytes_a, bytes_b):
                    at, own = 0, []
                    for part in parts:
                        at += len(part)
                        own.append(at)
                    ends.append(own)
                groups = by_hand(ids_a, ids_b, *ends)
        grouped.append(groups)
        for x, y in groups or []:
            for i in x:
                for j in y:
                    documents[i, j].add(number)
    best = defaultdict(int)
    for (i, _), found in documents.items():
        best[i] = max(best[i], len(found))
    out = []
    for groups in grouped:
        links = [(i, j) for x, y in groups or [] for i in x for j in y]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or [])
        counts = [len(documents[p]) for p in links]
        out.append((sum(len(x) for x, _ in groups or []), sum(len(y) for _, y in groups or []), len(groups or []), len(links), sum(n == best[p[0]] for p, n in zip(links, counts, strict=True)), sum(counts), sha256(shown.encode()).hexdigest() if shown else ""))
    return out


def by_hand(ids_a, ids_b, ends_a, ends_b):
    i = j = 0
    out = []
    for cut in sorted(set(ends_a) & set(ends_b)):
        x, y = [], []
        while i < len(ids_a) and ends_a[i] <= cut:
            x.append(ids_a[i])
            i += 1
        while j < len(ids_b) and ends_b[j] <= cut:
            y.append(ids_b[j])
            j += 1
        out.append((x, y))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op13(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(docs, brute(list(docs.values())), strict=True))
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in q.op13_token_alignment(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("hot", [1, 20, 100_000])
def test_odd_texts_repeats_and_clashing_columns(spark, hot):
    rows = [(i if i % 7 else None, t, "key", 1) for i, t in enumerate(ODD + ODD[:12])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, node int").repartition(3)
    want = sorted(zip([r[0] for r in rows], brute([r[1] for r in rows]), strict=True), key=str)
    got = sorted(((r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in alignment.align(docs, A, B, hot).collect()), key=str)
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, A, B).collect() == []
    none = spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align(none, A, B).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_pairs_held_in_several_groups_count_once(spark):
    """Documents of every pair, against the sets of documents."""
    texts = [t for t in ODD if t] * 2
    rows = alignment.aligned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B)
    rows = alignment.written(rows, "test-aligned")
    two, documents = alignment.load(A, B), defaultdict(set)
    _, counts = alignment.linked(rows, two.wide)
    for k, ids in enumerate(two.encode(texts)):
        if ids:
            a, b = (x.tolist() for x in ids)
            for x, y in by_hand(a, b, np.cumsum(two.a_bytes.sizes[a]).tolist(), np.cumsum(two.b_bytes.sizes[b]).tolist()):
                for i in x:
                    for j in y:
                        documents[(i << 32) | j].add(k)
    assert {r["pair"]: r["n"] for r in counts.collect()} == {p: len(d) for p, d in documents.items()}


def test_groups_under_one_hash_are_told_apart(monkeypatch):
    two = alignment.load(A, B)
    ids = two.encode([t for t in ODD if t])
    good = alignment.Grouped.of(two, ids)
    monkeypatch.setattr(alignment, "_mixed", lambda x: x * np.uint64(0))
    bad = alignment.Grouped.of(two, ids)
    assert len(good.distinct) == len(bad.distinct)
    assert np.array_equal(good.a[good.at_a[good.distinct[good.number]]], bad.a[bad.at_a[bad.distinct[bad.number]]])


def test_piece_ids_are_the_librarys(sf_dir, spark):
    pieces = tokens.PieceIds(B)
    assert pieces.fast is not None
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rng = random.Random(3)
    texts += [t or "" for t in ODD] + ["".join(rng.choice("abt th éñÉß\n.,'0ЖяΩ\u00ad\u0600") for _ in range(rng.randrange(200))) for _ in range(500)]
    assert [x.tolist() for x in pieces.encode(texts)] == pieces.library.encode(texts)
