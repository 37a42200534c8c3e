"""Token alignment against both libraries and a plain count of links."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from cases import SCHEMA, messy

from variorum.llm import token_alignment as T


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


MARKS: dict[str, int] = {}


def plain(text, tokenizers):
    """Groups of a text, from tokens' bytes one by one."""
    a, b = tokenizers
    if not text:
        return []
    raw = b" " + text.encode()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts = [T_bytes(a.id_to_token(i)) for i in ids[0]], [piece(b, i) for i in ids[1]]
    if any(b"".join(p) != raw for p in parts):
        return []
    ends = []
    for p in parts:
        at, own = 0, []
        for x in p:
            at += len(x)
            own.append(at)
        ends.append(own)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    nth = {c: k for k, c in enumerate(cuts)}
    out = [([], []) for _ in cuts]
    for k, (side, own) in enumerate(zip(ids, ends, strict=True)):
        at = 0
        for i, e in zip(side, own, strict=True):
            out[at][k].append(i)
            at += e in nth
    return out


def T_bytes(token):
    marks = MARKS
    for b in range(256) if not marks else ():
        c = chr(b)
        if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255):
            c = chr(256 + sum(not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255) for x in range(b)))
        marks[c] = b
    return bytes(marks[c] for c in token)


def piece(b, i):
    p = b.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()


def odd(n):
    r = random.Random(11)
    parts = ["the", " ", "  ", "\n", "\t", "don't", "naïve", "字字", "\U0001f600", "<|endoftext|>", "<s>", "</s>", "é", "12345", "▁", "\x00", "x" * 40, "—", "ﬁ", "é", "\r\n", "<0x41>", "Straße", " a", ".", "...", " ", "　"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("most", [T.FREQUENT, 40, 0])
def test_alignment(spark, tokenizers, most):
    texts = [t for _, t, *_ in messy()] + odd(150)
    rows = [(i % 140 if i % 11 else None, t, 5, "x", "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = T.align(docs, T.vocabularies(), most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = {t: plain(t, tokenizers) for t in set(texts)}
    held, best = Counter(), defaultdict(int)
    links = {t: Counter((x, y) for a, b in g for x in a for y in b) for t, g in found.items()}
    for t in texts:
        held.update(links[t].keys())
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    want = []
    for i, t, *_ in rows:
        g, own = found[t], links[t]
        digest = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else ""
        want.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for p, n in own.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in own.items()), digest))
    assert sum(w[3] > 0 for w in want) > 80
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_groups_and_empty(spark, tokenizers, empty):
    docs = spark.createDataFrame([(1, "Völlig naïve tokens, 字 and spaces   here", 1, "", ""), (2, None, 1, "", "")], SCHEMA)
    got = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in T.groups(docs, T.vocabularies()).collect()}
    assert got == {1: plain("Völlig naïve tokens, 字 and spaces   here", tokenizers), 2: []}
    assert T.align(empty, T.vocabularies()).count() == 0


def test_large_groups_and_long_runs(spark, tokenizers, monkeypatch):
    """Links of a large group are counted by distinct ids; runs of white space beyond the library's limit are encoded all the same."""
    coder = T._tokenizers(*T.vocabularies())
    text = "x" * 3000 + " " + "zq" * 500
    one = T.Aligned([text], coder).pairs()
    monkeypatch.setattr(T, "EXPANDED", 0)
    two = T.Aligned([text], coder).pairs()
    assert all((x == y).all() for x, y in zip(one, two, strict=True)) and one[2].max() > 1
    assert sum(coder.size_a[coder.encode_a([" " * 1_500_000 + "a"])[0]]) == 1_500_002
