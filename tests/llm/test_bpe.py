import json

import pytest
from gradus.llm import bpe
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
SPECIAL = ["", None, " ", "  \n\n  x ", "<|endoftext|>", "a" * 3000, "=" * 999, "don't we'll THEY'VE I'd", "漢字かな交じり文 絵文字👩‍👩‍👧é", "\x1c\x85  x​ y", "x" * 40 + "  \t\t 12345678901234567890", "tab\tand\r\nlines\n\n\n"]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(bpe.TOKENIZER)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids if x else []


def encode(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "text", "'own' ids", "0 words")
    return {r.doc_id: list(r.ids) for r in bpe.encode_texts(df, "doc_id", "text").collect()}, {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, "doc_id", "text").collect()}


def test_special_texts(spark, reference):
    ids, counts = encode(spark, SPECIAL)
    for i, t in enumerate(SPECIAL):
        assert ids[i] == reference(t) and counts[i] == len(ids[i]), t


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00", exclude_categories=("Cn", "Co", "Cs")), max_size=40), min_size=1, max_size=30))
def test_any_text(spark, reference, texts):
    ids, _ = encode(spark, texts)
    assert [ids[i] for i in range(len(texts))] == [reference(t) for t in texts]


def test_repeated_rows_and_null_keys(spark, reference):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (None, "other")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), list(r.ids)) for r in bpe.encode_texts(df, "doc_id", "text").collect())
    assert got == sorted([("1", reference("same")), ("1", reference("same")), ("None", reference("other"))])


def test_empty_table(spark):
    assert bpe.encode_texts(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_round_trip(spark):
    vocab = {i: t for t, i in json.load(open(bpe.TOKENIZER))["model"]["vocab"].items()}
    back = {c: b for b, c in enumerate(bpe.byte_alphabet())}
    ids, _ = encode(spark, [t for t in SPECIAL if t])
    for i, t in enumerate(t for t in SPECIAL if t):
        assert bytes(back[c] for x in ids[i] for c in vocab[x]).decode() == t


def test_two_tokenizers_in_one_session(spark, reference, tmp_path):
    """Another file is another tokenizer, also for a worker that has read the first one."""
    model = json.load(open(bpe.TOKENIZER, encoding="utf-8"))
    bare = tmp_path / "bytes.json"
    bare.write_text(json.dumps({"model": {"vocab": model["model"]["vocab"], "merges": []}}), encoding="utf-8")
    df = spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string")
    first = bpe.encode_texts(df, "doc_id", "text").head().ids
    second = bpe.encode_texts(df, "doc_id", "text", str(bare)).head().ids
    third = bpe.encode_texts(df, "doc_id", "text").head().ids
    assert list(first) == list(third) == reference("some words here") and len(second) == len("some words here")


def test_long_words(spark, reference):
    import base64
    import random

    rng = random.Random(1)
    texts = [base64.b64encode(rng.randbytes(n)).decode().translate({43: "a", 47: "b", 61: "c"} | {48 + i: 65 + i for i in range(10)}) for n in (190, 191, 3000)] + ["ab" * 2000 + " ok"]
    ids, _ = encode(spark, texts)
    assert [ids[i] for i in range(len(texts))] == [reference(t) for t in texts]
