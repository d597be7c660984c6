import json

import pytest

from scriptorium.plans import runs
from scriptorium.sources import readers, sinks
from scriptorium.streaming.words import token_frequency_stream

XML = """<?xml version="1.0"?>
<alto{ns}><Layout><Page WIDTH="100" HEIGHT="200"><PrintSpace>
<TextBlock ID="b1" HPOS="10" VPOS="20" WIDTH="30" HEIGHT="40"><Shape><Polygon POINTS="1 2 3 4 5 6"/></Shape></TextBlock>
<TextBlock ID="b2" HPOS="0" VPOS="0" WIDTH="5" HEIGHT="5"/>
</PrintSpace></Page></Layout></alto>"""


def gray_png(h, w, values):
    import struct
    import zlib

    raw = b"".join(b"\0" + bytes(values[y * w : (y + 1) * w]) for y in range(h))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_texts_and_lexicon_run(spark, tmp_path):
    t = tmp_path / "texts"
    t.mkdir()
    (t / "b.txt").write_text("Lo castell\nes gran")
    (t / "a.txt").write_text("lo rei [x] castel")
    (t / "c.md").write_text("ignored")
    (t / "sub").mkdir()
    (t / "sub/d.txt").write_text("deep")
    (tmp_path / "lex.json").write_text(json.dumps({"Rei": ["reis"], "castel": None, "Gran": ["grans"]}))
    assert {r.name for r in readers.text_files(spark, str(t)).collect()} == {"a.txt", "b.txt"}
    assert readers.text_files(spark, str(t), True).count() == 3
    assert [(r.line_no, r.text) for r in readers.text_lines(spark, str(t)).filter("stem = 'b'").collect()] == [(0, "Lo castell"), (1, "es gran")]
    lex = readers.lexicon_file(spark, str(tmp_path / "lex.json")).collect()
    assert [(r.position, r.headword, r.variants) for r in lex] == [(0, "Rei", ["reis"]), (1, "castel", None), (2, "Gran", ["grans"])]
    out = str(tmp_path / "out")
    got = runs.lexicon_evaluation(spark, str(t), str(tmp_path / "lex.json"), out)
    m = got["metrics"].first()
    assert m.known_words_exact == 3 and m.fuzzy_match_words == 1
    assert spark.read.json(f"{out}/metrics").first().oov_words == m.oov_words
    assert spark.read.option("header", True).csv(f"{out}/fuzzy_candidates").first().suggested_headword == "castel"
    assert spark.read.option("header", True).csv(f"{out}/top_unmatched").count() == 2
    with pytest.raises(Exception, match="(?i)not.*exist"):
        runs.lexicon_evaluation(spark, str(tmp_path / "none"), str(tmp_path / "lex.json"), out)


def test_corpus_run(spark, tmp_path):
    t = tmp_path / "texts"
    t.mkdir()
    (t / "a.txt").write_text("<p>" + "mot " * 40 + "</p>")
    (t / "b.txt").write_text("short")
    runs.unify_corpus(spark, str(t), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/corpus"), lineSep="\n\n<doc>\n\n").first().value == ("mot " * 40).strip()
    first = spark.read.text(str(tmp_path / "out/characters")).collect()[0].value
    assert first.split("\t") == ["'m'", "40"]


@pytest.mark.parametrize("ns", ["", ' xmlns="http://www.loc.gov/standards/alto/ns-v4#"'])
def test_page_xml(spark, tmp_path, ns):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/p1.xml").write_text(XML.format(ns=ns))
    blocks = readers.page_blocks(spark, str(tmp_path / "in"))
    got = {r.id: (r.stem, r.page_width, r.x1, r.y1, r.x2, r.y2, r.points) for r in blocks.collect()}
    assert got == {"b1": ("p1", 100.0, 10.0, 20.0, 40.0, 60.0, "1 2 3 4 5 6"), "b2": ("p1", 100.0, 0.0, 0.0, 5.0, 5.0, None)}
    assert sinks.zone_labels(blocks).first().label == "4 0.250000 0.200000 0.300000 0.200000\n4 0.025000 0.012500 0.050000 0.025000"
    sinks.write_page_xml(blocks, str(tmp_path / "out"))
    back = spark.read.format("xml").option("rowTag", "TextBlock").load(str(tmp_path / "out"))
    assert back.count() == 2
    found = spark.createDataFrame([("p1", "MainZone", 10.0, 20.0, 40.0, 60.0, 0.9, 0), ("p1", "Other", 0.0, 0.0, 5.0, 5.0, 0.9, 1)], "image string, class string, x1 double, y1 double, x2 double, y2 double, conf double, pos long")
    m = {r.iou_threshold: (r.tp, r.fp, r.fn) for r in runs.detection_evaluation(spark, str(tmp_path / "in"), found, str(tmp_path / "ev"))["metrics"].collect()}
    assert m == {t: (1, 0, 1) for t in (0.3, 0.5, 0.7)}


def test_segmentation_and_crops(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"imagename": "p.png", "lines": [{"id": "x", "baseline": [[1, 2], [30, 2]], "boundary": [[0, 0], [31, 0], [31, 9]], "text": ""}]}))
    (tmp_path / "q.json").write_text(json.dumps({"imagename": "q.png"}))
    seg = readers.segmentations(spark, str(tmp_path))
    assert {r.stem: len(r.lines) for r in seg.collect()} == {"p": 1, "q": 0}
    assert runs.page_crops(spark, str(tmp_path), str(tmp_path / "crops")).first().crop.w == 32.0


def test_images_and_filter_run(spark, tmp_path):
    for f in ("a", "b"):
        (tmp_path / "img" / f).mkdir(parents=True)
        for i in range(3):
            (tmp_path / "img" / f / f"{f}_line_{i}.png").write_bytes(gray_png(2 + 3 * (i == 2), 4, [0] * (4 * i) + [255] * 16))
    (tmp_path / "img/loose.PNG").write_bytes(gray_png(2, 4, [0] * 8))
    assert readers.image_files(spark, str(tmp_path / "img")).count() == 6
    got = runs.noisy_line_filter(spark, str(tmp_path / "img"), str(tmp_path / "out"))
    rows = {r.stem: r for r in got["tracking"].collect()}
    assert rows["a_line_1"].density == 0.5 and rows["a_line_2"].was_removed and "long_img" in rows["a_line_2"].reasons
    back = readers.tracking_file(spark, str(tmp_path / "out/filter_tracking"))
    assert {r.stem: r.reasons for r in back.collect()} == {k: v.reasons for k, v in rows.items()}
    assert spark.read.parquet(str(tmp_path / "out/lines")).groupBy("split").count().count() == 2
    done = runs.binarization(spark, str(tmp_path / "img"), str(tmp_path / "bin"), "otsu")
    assert {r.folder for r in done["summary"].collect()} >= {"a", "b"}
    assert runs.resize_manifest(got["tracking"], str(tmp_path / "sizes")).first().final.w > 0


def test_alignment_run(spark, tmp_path):
    (tmp_path / "t").mkdir()
    words = [f"{c}{d}mot" for c in "abcdefgh" for d in "aeiou" for _ in range(3)]
    (tmp_path / "ref.txt").write_text(" ".join(words))
    (tmp_path / "t/p2.txt").write_text(" ".join(words[60:]))
    (tmp_path / "t/p10.txt").write_text(" ".join(words[:60]))
    rows = runs.text_alignment(spark, str(tmp_path / "t"), str(tmp_path / "ref.txt"), str(tmp_path / "o"))
    assert rows.count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("lo rei lo")
    q = token_frequency_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("words_so_far").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        (tmp_path / "in/b.txt").write_text("rei\nrei")
        q.processAllAvailable()
        assert {r.word: r.n for r in spark.table("words_so_far").collect()} == {"lo": 2, "rei": 3}
    finally:
        q.stop()


def test_packs_keep_every_file(spark, tmp_path):
    from scriptorium import catalog

    rows = [(1, "a\r\nb"), (2, ""), (3, None), (1, "again"), (4, "é\n"), (None, "no name")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalog.QUERIES["text_scan"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((f"{i}.txt" if i else None, f"{i}" if i else None, t) for i, t in rows if t is not None), key=str)
    lines = [tuple(r) for r in catalog.QUERIES["line_scan"](spark, str(tmp_path)).collect()]
    want = [(f"{i}" if i else None, k, x) for i, t in rows if t is not None for k, x in enumerate(t.replace("\r\n", "\n").split("\n"))]
    assert sorted(lines, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("ns", ["", ' xmlns="http://www.loc.gov/standards/alto/ns-v4#"'])
def test_page_xml_of_a_pack(spark, tmp_path, ns):
    empty = "<alto><Layout><Page/></Layout></alto>"
    sinks.write_pack(spark.createDataFrame([("p1.xml", XML.format(ns=ns)), ("p2.xml", empty)], "name string, content string"), f"{tmp_path}/pack")
    (tmp_path / "p1.xml").write_text(XML.format(ns=ns))
    got = readers.blocks_of(readers.packed_files(spark, f"{tmp_path}/pack"))
    assert got.collect() == readers.page_blocks(spark, str(tmp_path)).collect() and got.count() == 2


def test_page_xml_scan_takes_no_file_for_each_page(spark, tmp_path, monkeypatch):
    from scriptorium import catalog

    made = []
    monkeypatch.setattr(catalog.sinks, "write_files", lambda files, path: made.append(path))
    assert catalog.QUERIES["page_xml_scan"](spark, "/root/testdata/sf0.001").count() > 1000 and not made


def test_a_folder_is_one_text_without_collecting_its_parts(spark, tmp_path):
    from scriptorium import catalog

    rows = [(i, f"é{i}\n" * (i % 7)) for i in range(300)] + [(300, None)]
    (tmp_path / "none").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rows[-1:], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    out = catalog.QUERIES["corpus_file"](spark, str(tmp_path))
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert [r.text for r in out.collect()] == ["".join(f"{t}\n\n<doc>\n\n" for _, t in rows[:-1])]
    assert [r.text for r in catalog.QUERIES["corpus_file"](spark, f"{tmp_path}/none").collect()] == [None]
