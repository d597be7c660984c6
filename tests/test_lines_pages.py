import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium import catalog
from scriptorium.functions import geometry as G
from scriptorium.functions import imaging
from scriptorium.operators import corpus, detection, lines, models, pages, tokenizer

MEASURES = "folder string, stem string, density double, size long, height int, width int"


@pytest.fixture(scope="module")
def measures(spark):
    r = np.random.default_rng(2)
    rows = [(f"f{i % 3}", str(i), float(r.beta(2, 9)), int(r.integers(1, 9000)), int(r.integers(10, 60)), int(r.integers(20, 400))) for i in range(400)]
    rows += [("f0", "900", 0.0, 1, 10, 20), ("f0", "901", 0.99, 2, 10, 20)]
    return rows, spark.createDataFrame(rows, MEASURES)


def test_tracking_and_funnel(measures):
    rows, df = measures
    d, s = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    d0, d1, s0 = np.quantile(d, 0.001), np.quantile(d, 0.997), np.quantile(s, 0.03)
    want = {}
    for r in rows:
        low, high, small, tall = r[2] <= d0, r[2] >= d1, r[3] <= s0, r[4] > r[5]
        reasons = sorted(n for n, c in (("density_low", low), ("density_high", high), ("size_low", small), ("long_img", tall), ("clean", not tall)) if c)
        want[r[1]] = (reasons, tall or ((low or high) and small))
    got = {r.stem: (r.reasons, r.was_removed) for r in lines.filter_tracking(df).collect()}
    assert got == want and any(x for _, x in want.values())
    funnel = {r.step: r.images for r in lines.filter_funnel(df).collect()}
    assert funnel["total"] == len(rows) and funnel["removed"] == sum(x for _, x in want.values()) and funnel["kept"] + funnel["removed"] == len(rows)
    stats = lines.describe(df, "density", lines.DENSITY).first()
    assert stats.p0_1 == pytest.approx(d0) and stats.p50 == pytest.approx(np.median(d)) and stats.std == pytest.approx(d.std(ddof=1))


def test_thresholds_decide_which_bounds_there_are(measures):
    _, df = measures
    f = lines.outlier_flags(df, (0.1,), ())
    assert f.filter("density_high or size_low or size_high").count() == 0 and f.filter("density_low").count() > 30
    with pytest.raises(ValueError):
        lines.outlier_flags(df, (0.1, 0.2, 0.3), ())


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], [1.0, 5.0], [0.0] * 50 + [1e9], list(range(100)) + [None], [-3.5, 7.25, -3.5, 0.0]])
def test_percentiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    ps = (0.0, 0.001, 0.03, 0.5, 0.997, 1.0)
    for few in (50_000, 3):  # counted at once, and by histograms of histograms
        assert lines.exact_percentiles(df, {"x": ps}, bins=8, few=few)["x"] == pytest.approx(np.quantile([v for v in values if v is not None], ps))
    assert lines.exact_percentiles(df.filter("false"), {"x": ps})["x"] == [None] * 6


def test_percentiles_of_two_columns_with_an_outlier(spark):
    r = np.random.default_rng(8)
    a, b = np.append(r.random(999), 1e9), np.append(r.integers(0, 4, 999).astype(float), -1e9)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    ps = (0.001, 0.25, 0.5, 0.9, 0.997)
    got = lines.exact_percentiles(df, {"a": ps, "b": ps}, bins=16, few=20)
    assert got["a"] == pytest.approx(np.quantile(a, ps)) and got["b"] == pytest.approx(np.quantile(b, ps))


def test_empty_measures(spark):
    df = spark.createDataFrame([], MEASURES)
    assert lines.filter_tracking(df).count() == 0
    assert {r.step: r.images for r in lines.filter_funnel(df).collect()}["total"] == 0


def greedy(truth, found, t):
    used = set()
    for p in sorted(found, key=lambda p: -p[4]):
        best, at = 0.0, None
        for i, g in enumerate(truth):
            w = max(0, min(p[2], g[2]) - max(p[0], g[0])) * max(0, min(p[3], g[3]) - max(p[1], g[1]))
            u = (p[2] - p[0]) * (p[3] - p[1]) + (g[2] - g[0]) * (g[3] - g[1]) - w
            v = w / u if u > 0 else 0
            if i not in used and v > best:
                best, at = v, i
        if at is not None and best >= t:
            used.add(at)
    return len(used)


def test_greedy_matching(spark):
    r = np.random.default_rng(3)
    box = lambda: (lambda x, y, w, h: (x, y, x + w, y + h))(*map(float, (*r.integers(0, 20, 2), *r.integers(5, 20, 2))))
    truth = {f"i{k}": [box() for _ in range(r.integers(0, 6))] for k in range(25)}
    found = {f"i{k}": [(*box(), float(r.integers(1, 4)) / 4) for _ in range(r.integers(0, 6))] for k in range(25)}
    t = spark.createDataFrame([(k, *b, i) for k, v in truth.items() for i, b in enumerate(v)], "image string, x1 double, y1 double, x2 double, y2 double, pos long")
    f = spark.createDataFrame([(k, *b, i) for k, v in found.items() for i, b in enumerate(v)], "image string, x1 double, y1 double, x2 double, y2 double, conf double, pos long")
    annotated = spark.createDataFrame([(k,) for k in truth], "image string")  # also those without a true box
    for m in detection.detection_metrics(t, f, annotated=annotated).collect():
        tp = sum(greedy(truth[k], found[k], m.iou_threshold) for k in truth)
        assert (m.tp, m.fp, m.fn) == (tp, sum(map(len, found.values())) - tp, sum(map(len, truth.values())) - tp)
        p, q = tp / (tp + m.fp), tp / (tp + m.fn)
        assert m.precision == pytest.approx(p) and m.f1 == pytest.approx(2 * p * q / (p + q) if p + q else 0)


def test_only_annotated_images_count(spark):
    shape = "image string, x1 double, y1 double, x2 double, y2 double, pos long"
    t = spark.createDataFrame([("a", 0.0, 0.0, 2.0, 2.0, 0), ("a", 5.0, 5.0, 9.0, 9.0, 1)], shape)
    f = spark.createDataFrame([("a", 0.0, 0.0, 2.0, 2.0, 0.9, 0), ("a", 5.0, 5.0, 9.0, 9.0, 0.8, 1), ("b", 0.0, 0.0, 1.0, 1.0, 0.9, 0), ("c", 0.0, 0.0, 1.0, 1.0, 0.9, 0)], shape.replace("pos", "conf double, pos"))
    m = detection.detection_metrics(t, f, (0.5,)).first()
    assert (m.tp, m.fp, m.fn) == (2, 0, 0)
    annotated = spark.createDataFrame([("a",), ("c",), ("d",)], "image string")
    m = detection.detection_metrics(t, f, (0.5,), annotated).first()
    assert (m.tp, m.fp, m.fn) == (2, 1, 0)


def test_boxes_that_only_touch_never_match(spark):
    b = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0, 0.9, 0)], "image string, x1 double, y1 double, x2 double, y2 double, conf double, pos long")
    c = b.withColumns({"x1": F.lit(1.0), "x2": F.lit(2.0)})
    assert detection.detection_metrics(b, c, (0.0,)).first().tp == 0


def cell(spark, col, df=None):
    return (df or spark.range(1)).select(col.alias("x")).first().x


def pts(*p):
    return F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in p))


def test_geometry(spark):
    box = G.bbox(pts((3, 4), (10, 2), (5, 9)))
    assert tuple(cell(spark, box)) == (3.0, 2.0, 10.0, 9.0)
    assert tuple(cell(spark, G.crop_size(box, "rectangle"))) == (3.0, 2.0, 7.0, 7.0)
    assert tuple(cell(spark, G.crop_size(box, "polygon"))) == (3.0, 2.0, 8.0, 8.0)
    with pytest.raises(ValueError):
        G.crop_size(box, "circle")
    assert cell(spark, G.clip_line(pts((0, 5), (99, 99)), box, F.lit(7.0), F.lit(7.0))) == [[0.0, 3.0], [6.0, 6.0]]
    assert cell(spark, G.middle_line(F.lit(10), F.lit(2))) == [[0.0, 1.0], [9.0, 1.0]]
    assert cell(spark, G.closed_polygon(F.lit("1 2 3 4 5 6"))) == "1 2 3 4 5 6 1 2"
    for same in ("1 2 3 4 1 2", "1 2", "1 2 3 4 5"):
        assert cell(spark, G.closed_polygon(F.lit(same))) == same
    g = G.centre_box(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(40.0), F.lit(100.0), F.lit(None).cast("double"))
    assert cell(spark, G.zone_label(g)) == "4 0.250000 40.000000 0.300000 40.000000"


@pytest.mark.parametrize(("w", "h", "want"), [(448, 224, (224, 112, 0, 56, 0, 56)), (100, 100, (224, 224, 0, 0, 0, 0)), (3, 224, (3, 224, 110, 0, 111, 0)), (5000, 1, (224, 1, 0, 111, 0, 112)), (448, 5, (224, 2, 0, 111, 0, 111)), (448, 7, (224, 4, 0, 110, 0, 110))])
def test_fitted_size(spark, w, h, want):
    assert tuple(cell(spark, G.fitted_size(F.lit(w), F.lit(h)))) == want


def test_iou(spark):
    a = F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(detection.BOX, (0, 0, 2, 2))))
    b = F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(detection.BOX, (1, 1, 3, 3))))
    z = F.struct(*(F.lit(0.0).alias(n) for n in detection.BOX))
    assert cell(spark, G.iou(a, b)) == pytest.approx(1 / 7) and cell(spark, G.iou(z, z)) == 0.0


def test_pages(spark):
    seg = spark.createDataFrame([("p1", [("a", [[0.0, 1.0], [9.0, 1.0]], [[0.0, 0.0], [9.0, 0.0], [9.0, 4.0]], "t"), ("b", [[0.0, 1.0]], None, "u"), ("c", [[1.0, 1.0], [5.0, 9.0]], [[1.0, 1.0], [5.0, 5.0]], "v")])], "imagename string, lines array<struct<id:string,baseline:array<array<double>>,boundary:array<array<double>>,text:string>>")
    rows = pages.page_lines(seg)
    assert [(r.idx, r.id) for r in rows.collect()] == [(0, "a"), (2, "c")]
    crops = {r.id: r for r in pages.line_crops(rows).collect()}
    assert crops["c"].crop.w == 5.0 and crops["c"].local_baseline == [[0.0, 0.0], [4.0, 4.0]]
    inv = spark.createDataFrame([("p1", "p1_line_2"), ("p1", "p1_line_3"), ("p2", "p2_line_0")], "folder string, stem string")
    assert sorted((r.stem, r.found) for r in pages.with_lines(inv, seg).collect()) == [("p1_line_2", True), ("p1_line_3", False), ("p2_line_0", False)]
    t = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("p", 3, None), ("q", 1, "z")], "page string, n int, text string")
    assert {r.page: r.text for r in pages.page_text(t, "page", "n").collect()} == {"p": "a\nb", "q": "z"}
    names = spark.createDataFrame([("8 - f. 3",)], "name string")
    other = spark.createDataFrame([("08_f_3", 5)], "name string, v int")
    assert pages.join_by_file_name(names, other).first().v == 5


def test_corpus(spark):
    html = "<p>" + "word " * 30 + "[note]</p>"
    df = spark.createDataFrame([("a", html), ("b", "short"), ("c", None)], "name string, text string")
    got = corpus.clean_corpus(df).collect()
    assert [(r.name, r.text) for r in got] == [("a", ("word " * 30).strip())]
    assert corpus.corpus_summary(corpus.clean_corpus(df)).first().chars == 149
    inv = corpus.char_inventory(spark.createDataFrame([("ab\na",), (None,), ("",)], "text string")).collect()
    assert [(r.character, r.n) for r in inv] == [("a", 2), ("\n", 1), ("b", 1)]
    u = spark.createDataFrame([("b", "two"), ("a", "one")], "name string, text string")
    assert corpus.unified(u, "name").first().text == "one\n\n<doc>\n\ntwo"


def test_imaging(spark):
    r = np.random.default_rng(4)
    img = np.where(r.random((20, 30)) < 0.3, 40, 200).astype(np.uint8)
    assert 40 <= imaging.otsu(img) < 200
    t, b = imaging.binary(img, "otsu")
    assert set(np.unique(b)) == {0, 255} and imaging.ink_share(b) == pytest.approx((img == 40).mean())
    best = max(range(256), key=lambda k: (lambda a, c: a.size * c.size * (a.mean() - c.mean()) ** 2 if a.size and c.size else -1)(img[img <= k].astype(float), img[img > k].astype(float)))
    assert imaging.otsu(img) == best
    with pytest.raises(ValueError):
        imaging.binary(img, "magic")
    rows = [("f", "a", 20, 30, img.tobytes()), ("f", "b", None, None, None), ("f", "c", 1, 2, bytes([0, 9]))]
    df = spark.createDataFrame(rows, "folder string, stem string, height int, width int, pixels binary")
    m = {x.stem: x for x in imaging.line_measures(df).collect()}
    assert m["b"].density == 0.0 and m["c"].density == 0.5 and m["a"].size == 600
    out = {x.stem: x for x in imaging.binarized(df, "otsu").collect()}
    assert out["a"].threshold == t and bytes(out["a"].pixels) == b.tobytes() and out["b"].threshold is None
    mask = imaging.zone_mask(5, 5, [(1.9, 1, 3, 2), (-2, 4, 9, 9)])
    assert (mask == 0).sum() == 3 * 2 + 5
    assert imaging.linear(np.array([[0, 75, 100, 250]], np.uint8)).tolist() == [[150, 0, 50, 255]]
    flat = np.full((12, 12), 90, np.uint8)
    assert len(np.unique(imaging.equalized(flat))) == 1 and imaging.equalized(img, 3.0, (3, 1)).shape == img.shape
    assert np.ptp(imaging.equalized((img // 8 + 100).astype(np.uint8)).astype(int)) > np.ptp((img // 8 + 100).astype(int))
    square = [(1, 1), (4, 1), (4, 3), (1, 3)]
    assert imaging.polygon_mask(6, 6, square).sum() == 4 * 3 and imaging.cropped(img, square).shape == (3, 4) and imaging.cropped(img, square, "rectangle").shape == (2, 3)
    assert imaging.polygon_mask(5, 5, [(0, 0), (4, 0), (0, 4)]).tolist() == [[x + y <= 4 for x in range(5)] for y in range(5)]
    with pytest.raises(ValueError):
        imaging.cropped(img, square, "circle")
    assert imaging.png(img)[:8] == b"\x89PNG\r\n\x1a\n"
    drawn = imaging.overlaid(img, [([(0, 0), (9, 0)], [(1, 5), (8, 5)]), (None, None)])
    assert drawn[1, 3].tolist() == [255, 0, 0] and drawn[5, 2].tolist() == [0, 0, 255]
    assert imaging.fitted(img, 224, 149, 0, 37, 224).shape == (224, 224)
    assert (imaging.fitted(np.full((9, 9), 77, np.uint8), 4, 4, 0, 0, 4) == 77).all()
    assert (imaging.blurred(np.full((4, 4), 9, np.uint8)) == 9).all()


def test_channel_statistics(spark):
    x = [0, 10, 255, 31]
    got = lines.channel_statistics(spark.createDataFrame([(v,) for v in x], "pixels int")).first()
    assert got.mean == pytest.approx(np.mean(x) / 255) and got.std == pytest.approx(np.std(x) / 255)
    w = lines.channel_statistics(spark.createDataFrame([(v, 2.0) for v in x], "pixels int, n double"), weight="n").first()
    assert math.isclose(w.std, got.std)


def test_tokenizers(spark):
    a = '{"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": [["a", "b"], ["ab", " "]]}}'
    b = '{"model": {"vocab": {"x": 0}, "merges": ["x y", "xy z"]}}'
    files = spark.createDataFrame([("a", a), ("b", b)], "name string, value string")
    assert sorted((r.name, r.rank, r.left, r.right) for r in tokenizer.merge_table(files).collect()) == [("a", 0, "a", "b"), ("a", 1, "ab", " "), ("b", 0, "x", "y"), ("b", 1, "xy", "z")]
    assert {r.token: r.id for r in tokenizer.vocabulary_table(files).filter("name = 'a'").collect()} == {"a": 0, "b": 1, "ab": 2}
    texts = spark.createDataFrame([("ababa aab",), (None,)], "text string")
    freq = tokenizer.merge_frequencies(tokenizer.merge_table(files).filter("name = 'a'"), texts)
    assert {r.token: r.n for r in freq.collect()} == {"ab": 3, "ab ": 0}
    assert tokenizer.rare_merges(freq, 1).count() == 1
    assert {(r.side, r.place, r.token) for r in tokenizer.top_merges(freq, 1).collect()} == {("top", 1, "ab"), ("bottom", 1, "ab ")}
    ids = spark.createDataFrame([("abcd", [1, 2])], "text string, ids array<int>")
    assert tokenizer.compression_ratio(ids.withColumn("ids", tokenizer.with_end(F.col("ids"), 9))).first().compression_ratio == pytest.approx(4 / 3)
    shape = "vocab_size_requested int, vocab_size_actual int, compression_ratio double"
    assert tokenizer.size_elbow(spark.createDataFrame([(50, 50, 1.0), (100, 100, 1.5), (150, 150, 1.51)], shape)).first()[0] == 100
    assert tokenizer.size_elbow(spark.createDataFrame([(50, 50, 1.0), (100, 50, 1.0), (150, 150, 1.5)], shape)).first()[0] == 150


def _library(merges):
    """The public library's encoder with some merges of the public vocabulary."""
    from tokenizers import Tokenizer

    from scriptorium.sources import sinks

    letters = sorted(tokenizer.byte_letters())
    return Tokenizer.from_str(sinks.tokenizer_json([*letters, *(a + b for a, b in merges)], merges))


@pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary here")
def test_size_sweep_equals_the_public_encoder(spark):
    texts = ["the theatre's  thing \n\n and don't, there", "", " ünïcode ça 中文 123 the", "x", None, "tab\t\tend  "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rules = catalog._MERGES[:200]
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rules)], "rank int, left string, right string")
    got = {r.vocab_size_requested: r for r in tokenizer.size_sweep(df, table, (100, 260, 300, 400, 900), alphabet=256).collect()}
    for size, k in ((100, 0), (260, 0), (300, 40), (400, 140), (900, 200)):
        library = _library(rules[:k])
        assert got[size].tokens == sum(len(library.encode(t).ids) for t in texts if t is not None), size
        assert got[size].vocab_size_actual == 260 + k and got[size].chars == sum(len(t or "") for t in texts)
    shown = tokenizer.encoded(df, table, 140).collect()
    for r in shown:
        if r.text:
            assert [bytes.fromhex(t) for t in r.tokens] == [bytes(tokenizer._LETTERS[c] for c in t) for t in _library(rules[:140]).encode(r.text).tokens[:-1]]
    own = tokenizer.size_sweep(df, table, (60,)).first()
    assert own.vocab_size_actual == 60 and own.chars == got[100].chars
    assert tokenizer.size_sweep(df.filter("false"), table, (300,)).first().tokens == 0


def test_images_masks_and_transcripts_meet(spark):
    inv = spark.createDataFrame([("p", "p_line_0", 0, True), ("p", "p_line_1", 1, True), ("p", "p_line_9", 9, False)], "folder string, stem string, idx int, found boolean")
    files = spark.createDataFrame([("p", "p_line_0"), ("p", "p_line_9")], "folder string, stem string")
    rows = pages.with_images(inv, files)
    assert {r.stem: r.image_found for r in rows.collect()} == {"p_line_0": True, "p_line_1": False, "p_line_9": True}
    texts = spark.createDataFrame([("p", "p_line_0", None, None), ("p", "p_line_9", "x", None)], "folder string, stem string, text string, error string")
    assert {r.stem: (r.status, r.text) for r in pages.transcribed(rows, texts).collect()} == {"p_line_0": ("empty", None), "p_line_1": ("failed", None), "p_line_9": ("failed", None)}


def _half(x):
    if x["n"] == 3:
        raise ValueError("three")
    return None if x["n"] == 2 else x["n"] / 2


def test_models_fail_by_row(spark):
    df = spark.createDataFrame([(i, f"k{i}") for i in range(5)], "n long, k string")
    got = {r.k: (r.half, r.error) for r in models.apply_model(df, lambda: _half, ["n"], "half", "double").collect()}
    assert got["k4"] == (2.0, None) and got["k2"] == (None, None) and got["k3"] == (None, "ValueError: three")
    slow = models.apply_model(df.limit(1), models.command(lambda x: ["sleep", "5"], 0.2), ["n"], "out")
    assert "TimeoutExpired" in slow.first().error
    assert models.counters(models.apply_model(df, models.command(lambda x: ["echo", str(x["n"])]), ["n"], "out")).first().success == 5


def test_files_and_runs(spark, tmp_path):
    from scriptorium.plans import runs
    from scriptorium.sources import readers, sinks

    img = np.full((6, 8), 200, np.uint8)
    images = spark.createDataFrame([("f", "p", 6, 8, img.tobytes())], "folder string, stem string, height int, width int, pixels binary")
    seg = spark.createDataFrame([("p", [("a", [[0.0, 3.0], [7.0, 3.0]], [[1.0, 1.0], [5.0, 1.0], [5.0, 4.0]], "t<&"), ("b", None, None, None)])], "imagename string, lines array<struct<id:string,baseline:array<array<double>>,boundary:array<array<double>>,text:string>>")
    assert runs.plot_bounds(spark, images, seg, f"{tmp_path}/plot") == 1 and runs.line_crops_as_files(spark, images, seg, f"{tmp_path}/crops") == 1
    assert (tmp_path / "crops/p/p_line_0.png").read_bytes()[:4] == b"\x89PNG"
    zones = spark.createDataFrame([("p", "MainZone", 1.0, 1.0, 2.0, 2.0)], "image string, class string, x1 double, y1 double, x2 double, y2 double")
    pages_ = spark.createDataFrame([("p", 6, 8), ("q", 6, 8)], "image string, height int, width int")
    got = runs.zone_masks(spark, pages_, zones, f"{tmp_path}/m")["summary"].first()
    assert (got.images, got.images_no_detections) == (2, 1) and (tmp_path / "m/masks/q.png").exists()
    sizes = spark.createDataFrame([("p", 8, 6)], "imagename string, width int, height int")
    xml = sinks.line_page_xml(seg, sizes).first()
    assert xml.name == "p.xml" and 'CONTENT="t&lt;&amp;"' in xml.content and 'BASELINE="0 3 7 3"' in xml.content and xml.content.count("<TextLine") == 2
    made = '{"imagename": "p", "lines": [{"id": "a", "baseline": [[0, 3]], "boundary": [[1, 1], [2, 2]], "text": "t"}]}'
    names = spark.createDataFrame([("1 - f.2", "/x/1.png"), ("3", "/x/3.png")], "name string, path string")
    masks = spark.createDataFrame([("01_f_2", "/m/1.png")], "stem string, path string")
    done = runs.page_segmentation(spark, names, masks, lambda: lambda x: made if x["mask"] else 1 / 0, spark.createDataFrame([("01_f_2", 8, 6)], "imagename string, width int, height int"), f"{tmp_path}/s")
    assert tuple(done["counters"].first()) == (2, 1, 1) and (tmp_path / "s/alto_format/01_f_2.xml").exists() and (tmp_path / "s/01_f_2.json").exists()
    inv = spark.createDataFrame([("p", "p_line_0", False), ("p", "p_line_1", False), ("p", "p_line_5", False), ("p", "p_line_0x", True), ("z", "z_line_0", False)], "folder string, stem string, was_removed boolean")
    found = spark.createDataFrame([("p", "p_line_0", "/i/0.png"), ("p", "p_line_1", "/i/1.png")], "folder string, stem string, path string")
    out = runs.transcription(spark, inv, seg, found, lambda: lambda x: "hello" if x["baseline"] else None, f"{tmp_path}/t")
    c = out["counters"].first()
    assert (c.total, c.processed, c.failed, c["empty"]) == (3, 1, 1, 1) and [r.folder for r in out["skipped"].collect()] == ["z"]
    assert (tmp_path / "t/texts/p_full.txt").read_text() == "hello\n" and (tmp_path / "t/texts/p/p_line_1.txt").read_text() == "\n"
    kept = spark.createDataFrame([("p", "a", False), ("p", "b", True)], "folder string, stem string, was_removed boolean")
    raw = spark.createDataFrame([("p", "a", "/i/a.png", b"1"), ("p", "b", "/i/b.png", b"2")], "folder string, stem string, path string, content binary")
    assert sinks.copy_kept_and_removed(kept, raw, f"{tmp_path}/k") == 2 and (tmp_path / "k/removed/p/b.png").read_bytes() == b"2"
    if os.path.exists(tokenizer.VOCABULARY):
        from tokenizers import Tokenizer

        runs.export_tokenizer(spark, readers.tokenizer_files(spark, os.path.dirname(tokenizer.VOCABULARY)), "byte_bpe_50k", 30, f"{tmp_path}/tok", ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[EOS]"))
        t = Tokenizer.from_file(str(tmp_path / "tok/tokenizer.json"))
        assert t.encode("the").tokens[-1] == "[EOS]" and t.get_vocab_size() == 5 + 256 + 30 and t.decode(t.encode(" the cat").ids) == " the cat"


def test_images_are_worked_on_in_parts(spark, monkeypatch):
    import pyarrow as pa

    rows = [("a", f"{i:03d}", 1, n, bytes(k % 256 for k in range(n)) if n else None) for i, n in enumerate([0, 3, 900, 2, 5000, 1, 0, 700, 700])]
    monkeypatch.setattr(imaging, "PIXELS", 1_000)
    cols = tuple(pa.array([r[k] for r in rows]) for k in (4, 2, 3))
    parts = list(imaging._parts(cols))
    assert [x for p in parts for x in p[0].to_pylist()] == [r[4] for r in rows] and len(parts) == 4
    assert [len(p[0]) for p in imaging._parts(tuple(c.slice(0, 0) for c in cols))] == [0]
    images = spark.createDataFrame(rows, "folder string, stem string, height int, width int, pixels binary").coalesce(1)
    many = images.unionByName(images.sparkSession.range(3000).select(F.lit("b").alias("folder"), F.col("id").cast("string").alias("stem"), F.lit(1).alias("height"), F.lit(3000).alias("width"), F.repeat(F.lit("ab "), 1000).cast("binary").alias("pixels"))).coalesce(1)
    black = {r.stem: r.threshold for r in imaging.binarized(many, "fixed", 97).filter("folder = 'b'").select("stem", "threshold", F.length("pixels").alias("n")).filter("n = 3000").collect()}
    assert len(black) == 3000
    got = {r.stem: r["values"] for r in imaging.standardized(images, 0.5, 0.25).collect()}
    for _, stem, _, n, p in rows:
        assert got[stem] == (None if p is None else pytest.approx([(x / 255.0 - 0.5) / 0.25 for x in p], abs=1e-6))
    assert imaging.standardized(many).filter("folder = 'b' and size(values) = 3000").count() == 3000


def test_merges_are_applied_to_all_pieces_at_once(spark):
    import random

    r = random.Random(3)
    letters = {b: c for c, b in tokenizer.byte_letters().items()}
    rules, known = [], [bytes([b]) for b in "abé".encode()]
    while len(rules) < 25:
        a, b = r.choice(known), r.choice(known)
        if len(a + b) < 7 and (a, b) not in rules:
            rules.append((a, b))
            known.append(a + b)
    texts = ["".join(r.choice("aabbé\0 ") for _ in range(r.randint(0, 60))) for _ in range(80)] + ["aaaaa aaaa", "", None]
    shown = lambda x: "".join(letters[c] for c in x)
    m = spark.createDataFrame([(i, shown(a), shown(b)) for i, (a, b) in enumerate(rules)], "rank int, left string, right string")
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    sweep = tokenizer.size_sweep(df, m, (260, 265, 272, 285), alphabet=256)
    assert "lambdafunction" not in sweep._jdf.queryExecution().toString()
    got = {x.vocab_size_requested: x.tokens for x in sweep.collect()}
    for size, k in ((260, 0), (265, 5), (272, 12), (285, 25)):
        each = tokenizer.encoded(df.filter("text is not null"), m, k).collect()
        assert got[size] == sum(len(x.tokens) for x in each) + len(each)


def test_joins_of_inventories_take_as_many_tasks_as_rows_need(spark, monkeypatch):
    from scriptorium import runtime

    monkeypatch.setattr(runtime, "TASK_ROWS", 50)
    inv = spark.range(600).select((F.col("id") % 3).cast("string").alias("folder"), F.concat_ws("_", (F.col("id") % 3).cast("string"), F.lit("line"), F.col("id").cast("string")).alias("stem"))
    files = inv.filter("cast(substring_index(stem, '_', -1) as int) % 2 = 0")
    out = pages.with_images(inv, files.union(files))
    assert out.rdd.getNumPartitions() == 12 and out.count() == 600 and out.filter("image_found").count() == 300
    texts = files.select("folder", "stem", F.lit("t").alias("text"), F.lit(None).cast("string").alias("error"))
    done = pages.transcribed(out.withColumns({"idx": F.lit(0), "found": F.lit(True)}), texts)
    assert done.rdd.getNumPartitions() == 12 and {r.status: r["count"] for r in done.groupBy("status").count().collect()} == {"ok": 300, "failed": 300}
    assert pages.with_images(inv.limit(40), files).count() == 40
