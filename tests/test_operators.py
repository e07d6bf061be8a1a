import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import geometry as G
from glyphmill.functions import images as I
from glyphmill.functions import strings as S
from glyphmill.functions import tokens as T
from glyphmill.operators import audits, buckets, preprocess, sampling, sets
from glyphmill.operators import evaluations as E
from glyphmill.operators import joins as J
from glyphmill.operators import windows as W
from glyphmill.sources import manifests as M
from glyphmill.sources import tfrecord as R
from glyphmill.streaming import parts as P


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_bucket_counts_and_boundaries(spark):
    assert buckets.shape_table(spark, 512, extra=((416, 624), (624, 416))).count() == 25
    assert buckets.shape_table(spark, 1024, extra=((832, 1248), (1248, 832))).count() == 45
    assert [(r.bh, r.bw) for r in buckets.shape_table(spark, 512).orderBy("idx").collect()] == buckets.grid_shapes(512)
    with pytest.raises(ValueError):
        buckets.shape_table(spark, 1000, 48)
    sizes = spark.createDataFrame([(128, 192), (10, 10), (64, 80)], "height int, width int")
    policy = buckets.Policy(((None, 32, 48), (None, 64, 80)), min_side=16)
    got = {(r.height, r.width): (r.bucket, r.exclusion) for r in policy.assign(sizes).collect()}
    assert got == {(128, 192): (0, None), (10, 10): (None, "source_too_small"), (64, 80): (1, None)}


def test_buckets_where_two_are_equally_near(spark):
    shapes = [(None, h, w) for h, w in buckets.grid_shapes(1024)] + [(2048, h, w) for h, w in buckets.grid_shapes(2048, 64)]
    policy = buckets.Policy(tuple(shapes))
    aspects = {Fraction(a).limit_denominator(1000) for t in policy.ties() for a in t}
    assert {Fraction(1), Fraction(1, 2), Fraction(7, 12)} <= aspects
    sizes = sorted({(a.denominator * k, a.numerator * k) for a in aspects for k in range(1, 4200) if max(a.numerator, a.denominator) * k <= 4200 and k * a.numerator % 8 == 0})

    def nearest(h, w):  # as the reference's selector
        fit = [(-(r or 0), abs(math.log((bw / bh) / (w / h))), -bh * bw, i) for i, (r, bh, bw) in enumerate(shapes) if (r is None or h * w >= r * r) and min(bh / h, bw / w) <= 1.0]
        return min(fit)[-1] if fit else None

    got = {(r.height, r.width): r.bucket for r in policy.assign(spark.createDataFrame(sizes, "height long, width long")).collect()}
    assert got == {s: nearest(*s) for s in sizes}


def test_tiers(spark):
    policy = buckets.Policy(tuple((r, r, r) for r in (1024, 1536, 2048)), min_area=1024 * 1024)
    sizes = spark.createDataFrame([(s, s) for s in (1023, 1024, 1535, 1536, 2047, 2048, 4096)], "height int, width int")
    got = {r.height: r.bh for r in policy.assign(sizes).collect()}
    assert got == {1023: None, 1024: 1024, 1535: 1024, 1536: 1536, 2047: 1536, 2048: 2048, 4096: 2048}


def test_epoch_steps(spark):
    rows = spark.createDataFrame([(0, 10), (1, 3), (2, 8), (3, 0)], "bucket int, n int")
    assert tuple(buckets.epoch_steps(rows, 4).first()) == (6, 4, 5, 3)


def test_water_fill(spark):
    rows = spark.createDataFrame([(0, 1), (1, 100), (2, 100)], "bucket int, capacity int")
    assert [r.quota for r in sampling.water_fill(rows, 10).orderBy("bucket").collect()] == [1, 5, 4]


def test_oversize_boundaries(spark):
    rows = spark.createDataFrame([(4096, 4096), (4097, 10), (5000, 5000)], "w int, h int")
    got = [r[0] for r in rows.select(audits.oversize(F.col("w"), F.col("h"), 4096 * 4096, 4096)).collect()]
    assert got == [None, "source_side_too_large", "source_too_many_pixels"]


def test_rejection_order(spark):
    rows = spark.createDataFrame([(1, "failed", "", True, 9, 9, 9), (2, "ok", " ", True, 9, 9, 9), (3, "ok", "x", True, 9, 9, 9), (4, "ok", "x", False, 99, 9, 9), (5, "ok", "x", False, 9, 9, 9)], "id int, status string, caption string, decode_error boolean, n_chars int, width int, height int")
    got = [r.reason for r in audits.rejections(rows, 10, 1000, 100).orderBy("id").collect()]
    assert got == ["caption_status", "empty_caption", "gpu_image_decode_error", "caption_too_long", None]


def test_strings(spark):
    r = one(spark, S.slug(F.lit("a b/ç?.png")), S.slug(F.lit("???")), S.parse_size(F.lit("12X7")), S.parse_size(F.lit("0x7")), S.target_aspect(F.lit("16:9"), F.lit(None).cast("string")), S.truth(F.lit("No")), S.duration(F.lit(3725)), S.stem(F.lit("d/a.b.jpg")), S.stem(F.lit("d/a.b.jpg"), True), S.prefix_has_word(F.lit("Die Straße"), "strasse"))
    assert list(r) == ["a_b_.png", "sample", (12, 7), None, 16 / 9, False, "1h2m", "a.b", "a", True]
    assert one(spark, S.quoted_words(F.lit("a 'Big  Cat' and 'x'")))[0] == ["big", "cat", "x"]
    assert one(spark, S.fenced_json(F.lit('```json\n{"a": [1,],}\n```')))[0] == '{"a": [1]}'


def test_ocr_items(spark):
    raw = [('[{"text":"a","score":0.5}]',), ('{"res":{"rec_texts":["a","b"],"rec_scores":[0.5]}}',), ("",), (None,), ("broken",)]
    got = [[tuple(x) for x in r[0]] for r in spark.createDataFrame(raw, "raw string").select(T.ocr_items(F.col("raw"))).collect()]
    assert got == [[("a", 0.5)], [("a", 0.5), ("b", None)], [], [], []]


def test_geometry(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    r = one(spark, G.iou(box(0, 0, 9, 9), box(0, 0, 9, 9)), G.relations(box(0, 0, 10, 10), box(50, 0, 60, 10)), G.relations(box(0, 0, 10, 10), box(0, 0, 10, 10)), G.hamming(F.lit(7), F.lit(0)))
    assert list(r) == [1.0, ["left of"], [], 3]
    shares = one(spark, G.share_coefficient(F.lit(4.0), F.lit(1.0), F.lit(0.5), 0.4), G.gradient_shares(F.lit(4.0), F.lit(1.0), F.lit(0.5), G.share_coefficient(F.lit(4.0), F.lit(1.0), F.lit(0.5), 0.4)))
    assert shares[1] == pytest.approx(0.4)


def test_word_accuracy_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([("a", 2, 3, 1, [0.75] * 3, 0.7), ("a", 2, 4, 3, [0.75] * 4, 0.7), ("a", 3, 6, 2, [0.25] * 6, 0.7)], "kind string, area int, total_words int, correct_words int, word_scores array<double>, score double")
    want = None
    for n in (1, 2, 3, 8):
        got = sorted(map(tuple, E.word_accuracy(rows.repartition(n), ["kind", "area"]).collect()), key=str)
        want = want or got
        assert got == want
    total = next(r for r in want if r[0] is None)
    assert total[3] == 13 and total[4] == round(6 / 13, 6) and total[5] == round((7 * 0.75 + 6 * 0.25) / 13, 6)


@pytest.mark.parametrize("n", [1, 2, 5, 40])
@pytest.mark.parametrize("workers", [1, 3, 8])
def test_even_shards(spark, n, workers):
    got = [r["count"] for r in sampling.even_shards(spark.range(n), "id", workers).groupBy("shard").count().collect()]
    assert sum(got) == n and len(got) == min(n, workers) and max(got) - min(got) <= 1


def test_batch_plan_resumes_and_repeats(spark):
    rows = spark.range(41).selectExpr("id", "id % 3 AS bucket")
    plan = sampling.batch_plan(rows, "bucket", "id", 4, 1, 0).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, sampling.batch_plan(rows.repartition(5), "bucket", "id", 4, 1, 0).collect()))
    steps = {}
    for r in plan:
        steps.setdefault(r.step, []).append(r)
    assert sorted(steps) == list(range(4 + 4 + 4)) and all(len(s) == 4 and len({r.bucket for r in s}) == 1 for s in steps.values())
    assert {r.id for r in plan} == set(range(41))
    dropped = sampling.batch_plan(rows, "bucket", "id", 4, 1, 0, drop_remainder=True)
    assert dropped.count() == 36 and dropped.select("id").distinct().count() == 36
    assert sampling.batch_plan_numpy(rows, "bucket", "id", "id", 4, 1, 0).count() == 48


def test_strict_lookup_fails(spark):
    rows, side = spark.range(3), spark.range(2).withColumn("x", F.lit(1))
    with pytest.raises(Exception, match="no row for"):
        J.strict_lookup(rows, side, "id").collect()
    with pytest.raises(Exception, match="duplicate"):
        J.strict_lookup(spark.range(2), side.union(side), "id").collect()
    assert J.strict_lookup(spark.range(2), side, "id").count() == 2


def test_positions_match_order(spark):
    got = J.with_position(spark.range(100).repartition(7), "id").collect()
    assert all(r.id == r.position for r in got)


def test_windows(spark):
    files = spark.createDataFrame([(0, 60), (1, 50), (2, 50), (3, 200), (4, 1)], "k int, n int")
    assert [r.part for r in W.greedy_groups(files, "k", "n", 100).orderBy("k").collect()] == [0, 1, 1, 2, 3]
    assert W.spaced(10, 4) == [0, 3, 6, 9]
    assert W.pad_to_multiple(spark.range(10), "id", 4).count() == 12
    assert sampling.thirds(11) == [4, 4, 3]


def test_sets(spark):
    assert spark.range(20000).where(sets.hash_fraction(F.col("id"), 0.25, "s")).count() == pytest.approx(5000, rel=0.05)
    assert spark.createDataFrame([(None,)], "id long").where(sets.hash_fraction(F.col("id"), 1.0, "s")).count() == 0


def test_preprocess_language(spark):
    df = spark.createDataFrame([([0.0, 255.0], ["a|b", "c"])], "image array<double>, caption array<string>")
    out = preprocess.STEPS.chain("value_range(-1, 1)|copy('caption', 'all')|first_caption()|keep('image', 'caption')")(df)
    assert tuple(out.first()) == ([-1.0, 1.0], "a|b")
    assert preprocess.split_bars("a('|')|b") == ["a('|')", "b"]
    with pytest.raises(KeyError):
        preprocess.STEPS.step("nothing()")
    with pytest.raises(ValueError):
        preprocess.STEPS.step("keep(__import__('os'))")
    with pytest.raises(KeyError):
        preprocess.STEPS.register("keep")(lambda: None)


def test_png_roundtrip_and_facts():
    rng = np.random.default_rng(1)
    for c in (1, 2, 3, 4):
        pixels = rng.integers(0, 256, (7, 5, c), dtype=np.uint8)
        assert (I.read_png(I.encode_png(pixels)) == pixels).all()
        assert I.header(I.encode_png(pixels)) == ("png", 5, 7, 1)
    assert I.read_png(I.encode_png(pixels)[:40]) is None and I.header(b"") is None
    half = np.full((4, 4, 4), 255, np.uint8)
    half[:2, :, 3] = 0
    assert I.transparent_share(half) == 0.5
    ramp = np.tile(np.arange(90, dtype=np.uint8)[None, :, None], (80, 1, 3))
    assert I.difference_hash(ramp) == -1
    assert I.stitched([half] * 4).shape == (8, 8, 4) and len(I.quadrants(ramp)) == 4
    mask = I.region_mask([(1.0, 0, 0, 7, 7), (0.5, 0, 0, 15, 7)], 16, 8)
    assert mask.tolist() == [[1.0, 0.5]]
    jpeg = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x10\x00\x20" + b"\0" * 12
    assert I.header(jpeg) == ("jpeg", 32, 16, 1)


def test_record_files(tmp_path):
    assert R.crc32c(b"123456789") == 0xE3069283
    features = {"image": [b"\x00\xff"], "image/shape": [1, -2, 300], "caption": [b"a", b""], "x": [0.5]}
    assert R.parse_example(R.example(features)) == features
    path = tmp_path / "a.tfrecord"
    path.write_bytes(R.framed(b"one") + R.framed(b""))
    assert list(R.records(str(path))) == [b"one", b""]
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(ValueError):
        list(R.records(str(path)))


def test_manifest_problems(spark, tmp_path):
    lines = ['{"id":"a","caption":"x","width":1,"height":1,"image_path":"p"}', "", '{"id":"b","caption":" ","width":1,"height":1,"image_path":"p"}', '{"id":"c","caption":"x","width":1,"height":1}', '{"id":"d","caption":"x","width":1,"height":1,"parquet_path":"p","row_group":0,"row_in_group":2}']
    path = tmp_path / "m.jsonl"
    path.write_text("\n".join(lines))
    got = {r.id: (r.variant, r.problem) for r in M.manifest(spark, str(path), strict=False).collect()}
    assert got == {"a": ("image", None), "b": ("image", "blank caption"), "c": (None, "no location"), "d": ("parquet", None)}
    with pytest.raises(Exception, match="blank caption"):
        M.manifest(spark, str(path)).collect()


def test_prompts_keys_and_reports(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two \n")
    (tmp_path / "b.json").write_text('[["k", " x "], ["l", "y"]]')
    (tmp_path / "c.jsonl").write_text('{"prompt":"p"}\n')
    read = lambda n: sorted(r.prompt for r in M.prompts(spark, str(tmp_path / n)).collect())
    assert read("a.txt") == ["one", "two"] and read("b.json") == ["x", "y"] and read("c.jsonl") == ["p"]
    done = tmp_path / "done"
    done.mkdir()
    (done / "1.json").write_text('{"a": "x"}')
    (done / "2.json").write_text('[{"b": "y"}, {"a": "z"}]')
    (done / "3.json").write_text("{broken")
    assert sorted(r.key for r in M.done_keys(spark, str(done)).collect()) == ["a", "b"]
    M.write_json(str(tmp_path / "r.json"), {"é": 1})
    assert "é" in (tmp_path / "r.json").read_text()
    with pytest.raises(ValueError):
        M.write_json(str(tmp_path / "r.json"), {"x": float("nan")})
    pages = M.gallery(spark.createDataFrame([("<b>",), ("a",), ("c",)], "c string"), str(tmp_path / "g"), ["c"], ["c"], page=2)
    assert sorted(map(tuple, pages.collect())) == [(0, 2), (1, 1)]
    assert "&lt;b&gt;" in (tmp_path / "g" / "page000000.html").read_text()
    with pytest.raises(ValueError):
        M.write_lines(spark.createDataFrame([], "line string"), str(tmp_path / "none"))


def test_parts_resume_and_verify(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.range(10).repartition(2).write.parquet(str(source))
    assert P.run_parts(spark, str(source), "id long", out, lambda b: b.where("id <> 3")) >= 2
    before = len(list((tmp_path / "out/receipts").glob("*.json")))
    assert P.run_parts(spark, str(source), "id long", out, lambda b: b) == before
    assert spark.read.parquet(f"{out}/parts").count() == 9 and P.verify_parts(spark, out) == []
    spark.range(3).write.mode("overwrite").parquet(f"{out}/parts/part=0")
    assert P.verify_parts(spark, out) == [0]
    P.ensure_identity(f"{out}/run.json", {"a": 1})
    with pytest.raises(ValueError):
        P.ensure_identity(f"{out}/run.json", {"a": 2})
    with P.exclusive(f"{out}/lock"), pytest.raises(RuntimeError), P.exclusive(f"{out}/lock"):
        pass


def test_near_pairs_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 20)]
    hashes = [h ^ (1 << int(rng.integers(0, 62))) for h in base for _ in range(4)]
    rows = [(i, i, h, 1.0 + (i % 2) * 0.2, i % 5) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "ord long, id long, hash long, aspect double, pixels int")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] < b[0] and a[4] != b[4] and bin((a[2] ^ b[2]) & (2**64 - 1)).count("1") <= 3 and a[3] == b[3]}
    assert {(r.first, r.second) for r in J.banded_pairs(df).select("first", "second").collect()} == want


def test_entry_without_training_data_operators():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 100
