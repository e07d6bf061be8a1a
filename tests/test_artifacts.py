import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import encoding as N
from glyphmill.functions import images as I
from glyphmill.operators import budget as B
from glyphmill.operators import evaluations as E
from glyphmill.operators import hooks
from glyphmill.sources import caches as C
from glyphmill.sources import manifests as M
from glyphmill.sources import sinks as K
from glyphmill.streaming import parts as P


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_encoded_captions_fit_or_fail(spark):
    df = rows(spark, [(1, "abc"), (2, None), (3, "é" * 9)], "id int, text string")
    got = {r.id: r.e for r in df.select("id", N.encoded(F.col("text"), 6, N.byte_encoder, "truncate").alias("e")).collect()}
    assert got[1].ids == [100, 101, 102, 1, 0, 0] and got[1].mask == [1, 1, 1, 1, 0, 0] and got[1].tokens == 4
    assert got[2].ids == [1, 0, 0, 0, 0, 0] and got[3].tokens == 19 and got[3].ids[-1] == 1 and got[3].mask == [1] * 6
    with pytest.raises(Exception, match="over the limit"):
        df.select(N.encoded(F.col("text"), 6)).collect()
    for bad in ({"limit": 0}, {"limit": 5, "overflow": "drop"}):
        with pytest.raises(ValueError):
            N.encoded(F.col("text"), **bad)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_tokenizer_files(spark, file):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path(file)
    texts = ["hello world", "", "Grüße  an\nalle", "word " * 500, None]
    df = rows(spark, list(enumerate(texts)), "id int, text string")
    got = [r.n for r in df.select("id", N.token_count(F.col("text"), N.file_encoder(path, after=(1,))).alias("n")).orderBy("id").collect()]
    if file.endswith(".json"):
        from tokenizers import Tokenizer

        count = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False))
    else:
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    assert got == [count(t or "") + 1 for t in texts]


def test_budget_refuses_and_reports(spark, tmp_path):
    source = f"{tmp_path}/m.jsonl"
    lines = [json.dumps({"id": f"a{i}", "caption": "x" * n, "width": 1, "height": 1, "image_path": "p"}) for i, n in enumerate((3, 200, 9, 700))]
    with open(source, "w") as out:
        out.write("\n".join([lines[0], "  ", *lines[1:]]) + "\n")
    tokens = N.token_count(F.col("caption"))
    report = B.filter_manifest(spark, source, f"{tmp_path}/out", 100, tokens)
    kept = sorted(open(f"{tmp_path}/out/{f}").read() for f in os.listdir(tmp_path / "out") if f.startswith("part-"))
    assert sorted(x for part in kept for x in part.splitlines()) == sorted([lines[0], lines[2]])
    assert (report["records"], report["kept"], report["dropped"], report["percentiles"]["max"]) == (4, 2, 2, 701)
    assert report["histogram_128"] == [{"lower": 0, "upper": 127, "count": 2}, {"lower": 128, "upper": 255, "count": 1}, {"lower": 640, "upper": 767, "count": 1}]
    assert sorted(r.id for r in spark.read.parquet(report["dropped_records"]).collect()) == ["a1", "a3"]
    with pytest.raises(FileExistsError):
        B.filter_manifest(spark, source, f"{tmp_path}/out", 100, tokens)
    for output, limit in ((source, 100), (f"{tmp_path}/sub/out", 100), (f"{tmp_path}/out2", 0), (f"{tmp_path}/out2", 2)):
        with pytest.raises(ValueError):
            B.filter_manifest(spark, source, output, limit, tokens)
    assert not os.path.exists(f"{tmp_path}/out2.report.json")


def payloads(spark, sizes):
    return rows(spark, [(f"k{i:03d}", "b" if i % 3 else "hot", bytes([i % 256]) * n) for i, n in enumerate(sizes)], "key string, bucket string, payload binary")


def test_cache_rolls_checks_and_fetches(spark, tmp_path):
    folder = str(tmp_path / "cache")
    sizes = [10, 30, 25, 90, 5, 64, 40, 1, 33, 7]
    C.write_cache(payloads(spark, sizes), folder, limit=64, part_bytes=100)
    got = {r.key: r for r in C.open_cache(spark, folder).collect()}
    for i, n in enumerate(sizes):
        r = got[f"k{i:03d}"]
        assert bytes(C.fetch(f"{folder}/{r.path}", r.offset, r.size)) == bytes([i]) * n
    by_file = {}
    for r in got.values():
        by_file.setdefault(r.path, []).append(r.size)
    assert all(sum(v) <= 64 or len(v) == 1 for v in by_file.values()) and any(len(v) > 1 for v in by_file.values())
    some = next(iter(got.values()))
    for offset, size in ((-1, 1), (0, 10**6)):
        with pytest.raises(ValueError, match="truncated"):
            C.fetch(f"{folder}/{some.path}", offset, size)


@pytest.mark.parametrize("harm", ["payload", "short", "summary", "gone", "manifest"])
def test_cache_gate_refuses_what_was_changed(spark, tmp_path, harm):
    folder = str(tmp_path / "cache")
    entries = C.write_cache(payloads(spark, [20, 30, 40]), folder, limit=1000)
    path = f"{folder}/{entries.first().path}"
    if harm == "payload":
        data = bytearray(open(path, "rb").read())
        data[0] ^= 1
        open(path, "wb").write(data)
    elif harm == "short":
        os.truncate(path, 3)
    elif harm == "gone":
        os.unlink(path)
    elif harm == "summary":
        os.unlink(f"{folder}/summary.json")
    else:
        entries.limit(1).write.mode("append").parquet(f"{folder}/manifest")
    with pytest.raises(ValueError):
        C.open_cache(spark, folder)
    if harm in ("payload", "short", "gone"):
        assert {r.problem for r in C.checked(spark.read.parquet(f"{folder}/manifest"), folder).collect()} - {None} <= {"checksum", "truncated", "missing"}


def test_pixels_and_masks_are_checked(tmp_path):
    image = np.arange(2 * 3 * 3, dtype=np.uint8)
    (tmp_path / "p.bin").write_bytes(b"__" + image.tobytes())
    assert (C.pixels(str(tmp_path / "p.bin"), 2, 2, 3) == image.reshape(2, 3, 3)).all()
    with pytest.raises(ValueError):
        C.pixels(str(tmp_path / "p.bin"), 3, 2, 3)
    for values, good in (([0, 0.5, 1, 0.25], True), ([0, 2, 0, 0], False), ([0, np.nan, 0, 0], False), ([-0.5, 0, 0, 0], False)):
        (tmp_path / f"m{good}{values[1]}.bin").write_bytes(np.array(values, "<f2").tobytes())
        path = str(tmp_path / f"m{good}{values[1]}.bin")
        if good:
            assert C.mask(path, 0, 2, 2).tolist() == [[0, 0.5], [1, 0.25]]
        else:
            with pytest.raises(ValueError):
                C.mask(path, 0, 2, 2)


def test_polygon_masks():
    box = [(2, 2), (9, 2), (9, 5), (2, 5)]
    want = I.region_mask([(0.75, 2, 2, 9, 5)], 16, 16)
    assert np.allclose(I.polygon_mask([(0.75, box)], 16, 16), want)
    assert np.allclose(I.polygon_mask([(1.0, box), (0.5, box)], 16, 16), I.region_mask([(1.0, 2, 2, 9, 5)], 16, 16))
    triangle = I.polygon_mask([(1.0, [(0, 0), (15, 0), (0, 15)])], 16, 16, cell=1)
    assert triangle[0].all() and triangle[:, 0].all() and not triangle[15, 1:].any() and triangle.sum() == 16 * 17 / 2


def test_region_loss_by_hand(spark):
    df = rows(spark, [([1.0, 2.0, 3.0, 4.0], [1.0, 0.0, 0.0, 4.0], [0.5, 1.0]), ([0.0, 0.0], [0.0, 2.0], [0.0, 0.0])], "prediction array<double>, target array<double>, mask array<double>")
    got = E.region_loss(df, 3.0).first()
    assert (got.flow, got.region, got.mask_mean, got.masked_share) == ((4 + 9 + 4) / 6, (4 * 1 + 9 * 0.25) / 6, 1.5 / 4, 0.5) and got.loss == got.flow + 3 * got.region
    with pytest.raises(ValueError):
        E.region_loss(df, float("nan"))


def test_spec_verdicts_by_hand(spark):
    objects = [("a", "cat", 0.9, "red", 0.0, 0.0, 10.0, 10.0), ("a", "dog", 0.8, "blue", 100.0, 0.0, 110.0, 10.0), ("a", "dog", 0.3, "red", -90.0, 0.0, -80.0, 10.0)]
    clause = lambda image, i, exclude, name, n, color=None, relation=None, target=None: (image, i, exclude, name, n, color, relation, target)
    clauses = {
        "right": [clause("a", 0, False, "cat", 1, "red"), clause("a", 1, False, "dog", 1, "blue", "right of", 0)],
        "colour": [clause("a", 0, False, "cat", 1, "blue")],
        "all of two": [clause("a", 0, False, "cat", 1), clause("a", 1, False, "dog", 2, None, "right of", 0)],
        "failed target": [clause("a", 0, False, "cat", 1, "blue"), clause("a", 1, False, "dog", 1, None, "right of", 0)],
        "excluded": [clause("a", 0, False, "cat", 1), clause("a", 1, True, "dog", 2)],
        "not excluded": [clause("a", 0, False, "cat", 1), clause("a", 1, True, "dog", 3)],
        "missing": [clause("a", 0, False, "bird", 1)],
    }
    schema = "image string, clause long, exclude boolean, class string, count int, color string, relation string, target long"
    o = rows(spark, objects, "image string, class string, confidence double, color string, x0 double, y0 double, x1 double, y1 double")
    got = {name: hooks.spec_verdicts(o, rows(spark, c, schema)).first().correct for name, c in clauses.items()}
    assert got == {"right": True, "colour": False, "all of two": False, "failed target": False, "excluded": False, "not excluded": True, "missing": False}


def test_published_report_is_awaited(tmp_path):
    path = str(tmp_path / "r.json")
    with pytest.raises(RuntimeError):
        P.await_published(path, "s", lambda: False, seconds=0.01)
    with pytest.raises(TimeoutError):
        P.await_published(path, "s", seconds=0.01, patience=0.05)
    M.write_json(path, {"source": "s", "n": 1})
    assert P.await_published(path, "s")["n"] == 1
    with pytest.raises(ValueError):
        P.await_published(path, "other")


def test_caption_batches_hold_the_size(spark, tmp_path):
    df = spark.range(0, 1201, numPartitions=1).selectExpr("concat('k', id) AS key", "concat(' c', id) AS caption")
    files = K.commit_batches(df, str(tmp_path), "key", "caption").collect()
    assert sorted(r.n for r in files) == [201, 500, 500]
    held = {k: v for r in files for k, v in json.loads((tmp_path / r.file).read_text()).items()}
    assert len(held) == 1201 and held["k7"] == "c7" and all(next(iter(json.loads((tmp_path / r.file).read_text()))) + ".json" == r.file for r in files)


def test_duplicate_nested_prompt_fails(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "2.json").write_text(json.dumps({"data_list": [{"index": 1, "prompt": "a"}, {"index": 1, "prompt": "b"}]}))
    with pytest.raises(Exception):  # noqa: B017
        K.nested_prompts(spark, str(tmp_path), ("c",), (2,)).collect()


def test_prompt_sets_by_name(spark, tmp_path):
    assert len(K.PROMPT_SETS) == 21
    (tmp_path / "geneval_repeated4.txt").write_text("a \n\n b\n")
    assert [r.prompt for r in K.prompt_set(spark, str(tmp_path), "geneval_repeated4").orderBy("position").collect()] == ["a", "", "b"]
    with pytest.raises(ValueError):
        K.prompt_set(spark, str(tmp_path), "other")


def test_tables_keep_any_text(spark, tmp_path):
    texts = ['a "quoted", text', "line\nbreak", "tab\there", "back\\slash", "", "  blanks ", None]
    df = rows(spark, list(enumerate(texts)), "id int, text string")
    for name, separator in (("c", ","), ("t", "\t")):
        K.write_table(df, f"{tmp_path}/{name}", separator)
        assert [r.text for r in K.read_table(spark, f"{tmp_path}/{name}", "id int, text string", separator).orderBy("id").collect()] == texts


def test_shape_lines_last_wins_and_null_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"image_path":"p","width":5,"height":9}\n\n{"image_path":"q","width":1,"height":2}\n{"image_path":"p","width":8,"height":7}\n')
    assert sorted(map(tuple, M.shape_metadata(spark, f"{tmp_path}/a.jsonl").collect())) == [("p", 7), ("q", 1)]
    (tmp_path / "b.jsonl").write_text('{"image_path":"p","width":null,"height":9}\n')
    with pytest.raises(Exception, match="a field is missing"):
        M.shape_metadata(spark, f"{tmp_path}/b.jsonl").collect()


def test_row_groups_are_fetched_by_place(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = f"{tmp_path}/f.parquet"
    pq.write_table(pa.table({"caption": [f"c{i}" for i in range(10)], "x": list(range(10))}), path, row_group_size=4)
    (tmp_path / "broken.parquet").write_bytes(b"no")
    want = [("a", path, 1, 2), ("b", path, 2, 1), ("c", path, 2, 2), ("d", path, 9, 0), ("e", path, 0, -1), ("f", f"{tmp_path}/broken.parquet", 0, 0), ("g", f"{tmp_path}/none.parquet", 0, 0)]
    df = rows(spark, want, "id string, path string, row_group long, row_in_group long")
    got = {r.id: (r.caption, r.problem) for r in M.fetch_rows(df, {"caption": "string"}).collect()}
    assert got["a"] == ("c6", None) and got["b"] == ("c9", None) and [got[k][1] for k in "cde"] == ["no row", "no row group", "no row"]
    assert got["f"][1].startswith("unreadable") and got["g"][1].startswith("unreadable")
    assert {r.problem for r in M.fetch_rows(df.limit(1), {"prompt": "string"}).collect()} == {"no column prompt"}


def test_downloads_check_what_they_wrote(spark, tmp_path):
    from glyphmill.sources import downloads as D

    def fetch(url):
        if url == "gone":
            raise OSError("no such host")
        return url.encode()

    df = rows(spark, [(0, "a", "good"), (10001, " b ", "good"), (2, "c", "bad"), (3, "d", "gone"), (4, None, "good"), (5, "e", None)], "position long, id string, url string")
    run = lambda: {r.id: (r.state, r.path) for r in D.downloaded(df, str(tmp_path), fetch, lambda data: data == b"good").collect()}
    first, second = run(), run()
    assert {k: v[0] for k, v in first.items()} == {"a": "written", " b ": "written", "c": "invalid", "d": "failed", None: "skipped", "e": "failed"}
    assert first[" b "][1] == f"{tmp_path}/1/b.jpg" and second["a"][0] == "there" and not (tmp_path / "0" / "c.jpg").exists()
    (tmp_path / "0" / "a.jpg").write_bytes(b"cut")
    assert run()["a"][0] == "written"


def test_exported_names_stay_in_the_folder(spark, tmp_path):
    with pytest.raises(Exception, match="leaves the folder"):
        M.export_files(rows(spark, [("../x", b"1")], "name string, data binary"), f"{tmp_path}/out", "name", "data").collect()


def test_buffered_shuffle_keeps_rows(spark):
    df = spark.range(0, 500, numPartitions=2)
    got = [r.id for r in P.buffered_shuffle(df, 32, 1).collect()]
    assert sorted(got) == list(range(500)) and got != sorted(got)
    chunks = P.ordered_chunks(spark.range(0, 100, numPartitions=1), lambda c: [(i * 2,) for (i,) in c], "id long", size=7)
    assert [r.id for r in chunks.collect()] == [2 * i for i in range(100)]


def test_islands_and_positions_over_ranges(spark):
    from glyphmill.operators import joins as J
    from glyphmill.operators import windows as W

    values = [("hot" if i % 5 else "b", i, "xxyyyz"[i * 7 % 6]) for i in range(300)]
    df = rows(spark, values, "g string, at long, v string").repartition(5)
    got = {(r.g, r.at): (r.island, r.chunk, r.p) for r in J.with_group_position(W.islands(df, ["g"], "at", "v", 2), ["g"], ["at"], "p").collect()}
    for g in ("hot", "b"):
        island, chunk, before, place = 0, 0, None, 0
        for _, at, v in sorted(x for x in values if x[0] == g):
            island, chunk = (island, chunk + 1) if v == before else (island + 1, 0)
            assert got[g, at] == (island, chunk // 2, place)
            before, place = v, place + 1
    total = {r.at: r.t for r in J.running_total(df, ["at"], F.col("at"), "t").collect()}
    assert all(total[i] == i * (i + 1) // 2 for i in range(300))
