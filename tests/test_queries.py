import difflib
import math
import re
from collections import Counter

import duckdb
import pytest
from compare import assert_same, database

from glyphmill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        assert_same(got, db.sql(registry.ORACLES[name]).df())
    else:
        assert len(got)


def test_every_query_says_what_it_covers():
    assert set(registry.COVERS) == set(registry.QUERIES)


def test_images_column_pruned(spark):
    plan = registry.QUERIES["bucket_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[-1]
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_quoted_words_of_whole_texts(spark):
    prompts = {d.doc_id: "say '" + d.text.replace("\n", "'\n'") + "' and 'Two  Words'" for d in rows_of(spark, "documents")}
    found = {r.doc_id: r.words for r in registry.QUERIES["quoted_words"](spark, SF).collect()}
    assert found == {i: "|".join(w for m in re.findall(r"'(.*?)'", p) for w in m.lower().split()) for i, p in prompts.items()}
    assert all(found[d.doc_id] == "|".join([*d.text.lower().split(), "two", "words"]) for d in rows_of(spark, "documents") if "'" not in d.text)


def test_every_word_is_looked_up(spark):
    words = {r.item_id: r.text.split(" ") for r in rows_of(spark, "benchmark")}
    nearest = registry.QUERIES["nearest_word"](spark, SF).collect()
    assert sorted((r.item_id, r.place) for r in nearest) == sorted((k, i) for k, w in words.items() if k + 1 in words for i in range(len(w)))
    closest = registry.QUERIES["closest_words"](spark, SF).collect()
    assert sorted((r.item_id, r.place) for r in closest) == sorted((k, i) for k, w in words.items() for i in range(len(w)))
    for r in closest[::29]:
        rest = words[r.item_id][: r.place] + words[r.item_id][r.place + 1 :]
        assert r.match == next(iter(difflib.get_close_matches(r.word, rest, 1, 0.0)), None)


def test_model_slot_takes_every_document(spark):
    found = {r.doc_id: r.caption for r in registry.QUERIES["model_slot"](spark, SF).collect()}
    assert found == {d.doc_id: f"n{len(d.text)}" for d in rows_of(spark, "documents")}


def test_sorted_results_are_not_cut(spark):
    docs = sorted(rows_of(spark, "documents"), key=lambda d: d.doc_id)
    assert [tuple(r) for r in registry.QUERIES["numeric_stems"](spark, SF).collect()] == [divmod(d.doc_id, 10) for d in docs]
    counts = Counter(f"{d.lang}/{d.source}" for d in docs).most_common()  # ties: first seen
    assert [tuple(r) for r in registry.QUERIES["most_common_modes"](spark, SF).collect()] == counts


def test_dense_bins_are_counted_and_taken_exactly(spark, tmp_path):
    spark.range(400).selectExpr("id * 50 AS doc_id", "'s' AS source", "'t' AS text", "'en' AS lang", "1L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    at = lambda i: ((1 << i % 60), (200 + i * 7919 % 4000) / (200 + i * 104729 % 4000), i % 7)
    rows = [(i, *at(i)) for i in range(0, 20000, 50)]
    want = sorted((a, b) for a, h, r, p in rows for b, k, q, s in rows if a < b and p != s and (h ^ k).bit_count() <= 3 and abs(math.log(q / r)) <= 0.05)
    assert sorted((r.first, r.second) for r in registry.QUERIES["near_dup_bands_exact"](spark, str(tmp_path)).select("first", "second").toPandas().itertuples()) == want
    bins = Counter((b, h >> 16 * b & 65535) for _, h, _, _ in rows for b in range(4))
    skipped = sum(max(n - 257, 0) for n in bins.values())
    assert tuple(registry.QUERIES["near_dup_skipped"](spark, str(tmp_path)).first()) == (1600, skipped) and skipped
    assert registry.QUERIES["near_dup_bands"](spark, str(tmp_path)).count() <= len(want)


@pytest.fixture(scope="module")
def every_size(spark, tmp_path_factory):
    """Documents whose images have every size that the image view gives."""
    folder = str(tmp_path_factory.mktemp("every_size"))
    spark.range(4000).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars").write.parquet(f"{folder}/documents.parquet")
    return folder


def with_documents(sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet/*.parquet')")
    return db


@pytest.mark.parametrize("name", ["bucket_assign", "bucket_counts", "padding_stats"])
def test_buckets_of_every_size(spark, every_size, name):
    assert_same(registry.QUERIES[name](spark, every_size).toPandas(), with_documents(every_size).sql(registry.ORACLES[name]).df())


def test_mean_padding_just_below_a_half(spark, tmp_path):
    """Three images of one bucket whose mean, in any order of addition, is one bit below 0.1246875."""
    spark.createDataFrame([(i, "t", "en", "s", 1) for i in (125, 520, 638)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(registry.QUERIES["padding_stats"](spark, str(tmp_path)).toPandas(), with_documents(tmp_path).sql(registry.ORACLES["padding_stats"]).df())


@pytest.fixture(scope="module")
def odd_captions(spark, tmp_path_factory):
    """Documents whose captions tell words of ASCII from words of Unicode and spaces from other blanks; ids that no other rule rejects."""
    folder = str(tmp_path_factory.mktemp("odd_captions"))
    words = "é theé éthe thé İthe theİ THE the_ ẞthe a.é.b.c.d.e.f.g.h.i.the a.b.c.d.e.f.g.h.i.j.the éa.éb.éc.éd.ée.éf.ég.éh.éi.the ñ.é.a.b.c.d.e.f.g.h.i.the".split()
    texts = [*words, None, "", "  ", "\n", " \n", "\t", "\u00a0", "\u3000 \u2003", "\u200b", "\u00a0the"]
    ids = [i for i in range(1, 400) if i % 53 and i % 41 and (200 + i * 7919 % 4000) * (200 + i * 104729 % 4000) <= 12_000_000 and max(i * 7919 % 4000, i * 104729 % 4000) <= 3896]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=False)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["reject_cascade", "reject_counts"])
def test_rejections_of_odd_captions(spark, odd_captions, name):
    assert_same(registry.QUERIES[name](spark, odd_captions).toPandas(), with_documents(odd_captions).sql(registry.ORACLES[name]).df())
