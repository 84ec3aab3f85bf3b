import hashlib
import random
import sys

import pytest
from tokenizers import Tokenizer

from orrery.llm import bpe

ODD = ["", " ", "\n", "a", "  a  b\t\tc \n\n d", "don't we'll I'd 'tis", "x<|endoftext|>y <|endoftext|>", "<|endoftext|", "héé 中文 日本語 🙂🙂 ​\u0000", "aaaaaaaaaaaaaaaaaaaaa", "=" * 500, "0123456789" * 9, "\x1c\x1d\x85\xa0  a", "a" * 3000]


@pytest.fixture(scope="module")
def both():
    path = bpe.default_vocabulary()
    theirs = Tokenizer.from_file(path)
    theirs.no_truncation()
    theirs.no_padding()
    with open(path, encoding="utf-8") as f:
        return theirs, bpe.BpeModel(f.read())


def ids(model, text):
    raw = model.encode(text)
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def test_odd_texts(both):
    theirs, ours = both
    for text in ODD:
        got = ids(ours, text)
        assert got == theirs.encode(text, add_special_tokens=False).ids, text
        assert ours.decode(ours.encode(text)) == text == theirs.decode(got, skip_special_tokens=False)


def test_every_code_point(both):
    theirs, ours = both
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c} {c}a" for c in points[at : at + 64]) for at in range(0, len(points), 64)]
    differ = [t for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True) if e.ids != ids(ours, t)]
    # Only code points that one library's Unicode tables know as letters or digits and the other's don't.
    assert len(differ) <= 0.01 * len(texts)


def test_random_strings(both):
    theirs, ours = both
    rng = random.Random(1)
    for alphabet in ("ab ", "the andi", "aeiou rstln\n", "01 .,-=", "éèçàüß añ"):
        for _ in range(150):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80)))
            assert ids(ours, text) == theirs.encode(text, add_special_tokens=False).ids


def test_documents(spark, both):
    theirs, _ = both
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, None])], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(rows)).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "ids", "decoded"}
    for r in out:
        want = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in want)
        assert r.decoded == (r.text or "")
    assert bpe.decode(bpe.encode(rows.limit(0))).collect() == []


def test_columns_go_to_the_workers_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(bpe, "_mapped", lambda rows, path, schema, work: seen.append((rows.columns, schema)))
    rows = spark.createDataFrame([(1, "a", b"")], "doc_id long, text string, ids binary")
    bpe.encode(rows.drop("ids"))
    bpe.encode(rows, keep=False)
    bpe.decode(rows.drop("text"))
    assert seen == [(["doc_id", "text"], "`doc_id` bigint, `text` string, ids binary"), (["doc_id", "text"], "`doc_id` bigint, ids binary"), (["doc_id", "ids"], "`doc_id` bigint, `ids` binary, decoded string")]


def test_query(spark, sf_dir):
    from orrery.llm.common import table

    theirs = Tokenizer.from_file(bpe.default_vocabulary())
    want = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    for r in bpe.op5(spark, sf_dir).collect():
        e = theirs.encode(want[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(e)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in e)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(e, skip_special_tokens=False).encode()).hexdigest()
