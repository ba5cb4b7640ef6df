import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_ngramjoin import brute as jaccard
from tests.llm.test_suffixdedup import brute as repeated


def as_dict(df):
    rows = df.collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_stages(spark, sf, tmp_path):
    """Each stage against a plain version of its decision."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = as_dict(docs)
    one = as_dict(cp.language(spark, docs, sf))
    assert set(one) <= set(first) and all(one[i] == first[i] for i in one)
    assert all(any(c.isalpha() for c in first[i].text) for i in one) and len(one) > 0.98 * len(first)
    docs = spark.createDataFrame(list(one.values()), docs.schema)
    two = as_dict(cp.good_quality(spark, docs, sf))
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i in one if label.get(i) == 1]
    assert sum(i in two for i in good) >= 0.9 * len(good)
    docs = spark.createDataFrame(list(two.values()), docs.schema)
    three = as_dict(cp.near_duplicates(spark, docs, sf))
    _, comp = jaccard([(i, r.text) for i, r in two.items()], 5, 80)
    assert set(three) == {i for i in two if comp[i] == i}
    docs = spark.createDataFrame(list(three.values()), docs.schema)
    four = as_dict(cp.repeats(spark, docs, sf))
    want = {r[0]: r for r in repeated([(i, r.text) for i, r in three.items()])}
    for i, r in three.items():
        if want[i][2] == 0:
            assert four[i].text == r.text and four[i].lang == r.lang and four[i].source == r.source
        elif i in four:
            assert len(r.text.encode()) - want[i][2] - 6 * want[i][3] <= len(four[i].text.encode()) <= len(r.text.encode()) - want[i][2]
    docs = spark.createDataFrame(list(four.values()), docs.schema)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces: dict = {}
    for r in cp.packed(spark, docs, sf).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    for i, r in four.items():
        assert np.frombuffer(b"".join(x for _, x in sorted(pieces[i])), "<u4").tolist() == library.encode(r.text, add_special_tokens=False).ids + [2]
    whole: dict = {}
    for r in cp.run(spark, sf).collect():
        whole.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in whole.items()} == {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()}


def test_empty(spark, sf, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert cp.run(spark, f"file://{tmp_path}").count() == 0


def test_odd_rows(spark, sf):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "the and of it is", None, None, None), (3, "the and of it is", None, None, None), (4, "the and " * 9000, "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == cp.COLUMNS
    assert cp.packed(spark, docs, sf).count() >= docs.count()


def test_cut_characters(spark, sf):
    """A cut inside a character leaves valid text."""
    common = "\u00e8" * 30
    docs = spark.createDataFrame([(1, "a\u00e9" + common, "fr", "s", 1), (2, "b\u00f9 xyz " + common + "\u00e9 the end", "fr", "s", 1), (3, "clean \ufffd text", "fr", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = as_dict(cp.repeats(spark, docs, sf))
    assert got[2].text.startswith("b\u00f9 xyz ") and got[2].text.endswith(" the end") and "\ufffd" not in got[2].text
    assert got[3].text == "clean \ufffd text" and got[1].text == "a\u00e9" + common


def test_rows_not_ids(spark, sf):
    """A row goes or stays by its own text, whatever its id."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    clean = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and n_chars between 500 and 1500").orderBy("doc_id").limit(40).collect()]
    rows = [(i % 7 if i % 5 else None, t, "en", "s", 1, 1) for i, t in enumerate(clean)]
    docs = spark.createDataFrame([*rows, (None, "12 34 ...", "en", "s", 1, 1), (3, "+-+-", None, None, None, 1), (3, None, None, None, None, 1)], schema)
    got = cp.language(spark, docs, sf)
    assert got.columns == cp.COLUMNS and sorted(r.text for r in got.collect()) == sorted(clean)
    good = cp.good_quality(spark, docs, sf)
    assert good.columns == cp.COLUMNS and {r.text for r in good.collect()} & set(clean)
    twice = spark.createDataFrame([(1, clean[0]), (1, clean[0] + " x"), (1, clean[1]), (None, clean[1]), (None, clean[2]), (None, clean[3])], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1L n_chars")
    _, comp = jaccard([(0, clean[0]), (1, clean[0] + " x"), (2, clean[1]), (3, clean[1]), (4, clean[2]), (5, clean[3])], 5, 80)
    assert cp.near_duplicates(spark, twice, sf).count() == len(set(comp.values()))
