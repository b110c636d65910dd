"""Bitmaps and marks."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import codecs, marks
from quire.sources import images

PAGE = np.array([[int(c == "X") for c in row] for row in ("XX...X..", "X...X...", "........", ".....XX.", ".X...X..")], np.uint8)


def test_codec():
    for most, pixels in ((1, PAGE), (255, PAGE * 200)):
        kind, width, height, top, back = images.decoded(images.encoded(pixels, most))
        assert (width, height, top) == (8, 5, most) and (back == pixels).all()
    assert images.decoded(b"P1 # note\n3 1\n1 0 1\n")[4].tolist() == [[1, 0, 1]]
    assert images.decoded(b"P2\n2 1\n255\n7 9\n")[4].tolist() == [[7, 9]]
    with pytest.raises(ValueError):
        images.decoded(b"P6\n1 1\n255\n...")


def test_marks(spark, tmp_path):
    (tmp_path / "a.pbm").write_bytes(images.encoded(PAGE))
    found = marks.extracted(images.read(spark, str(tmp_path))).cache()
    rows = {r["mark"]: r for r in found.collect()}
    assert [(r["xpos"], r["ypos"], r["width"], r["height"], r["area"]) for _, r in sorted(rows.items())] == [(0, 0, 2, 2, 3), (4, 0, 2, 2, 2), (5, 3, 2, 2, 3), (1, 4, 1, 1, 1)]
    assert rows[0]["bitmap"] == rows[2]["bitmap"] and rows[0]["h_runs"] == 2 and rows[1]["v_runs"] == 2
    order = [r["mark"] for r in marks.in_reading_order(found, 2).orderBy("position").collect()]
    assert order == [0, 1, 3, 2]
    shelf = marks.library(found)
    assert {r["n"] for r in shelf.collect()} == {1, 2}
    got = {r["mark"]: r["score"] for r in marks.matched(found, shelf).collect()}
    assert got == dict.fromkeys(range(4), 0)
    only = shelf.where(F.col("n") == 2)
    scores = {r["mark"]: r["score"] for r in marks.matched(found, only).collect()}
    assert scores[0] == scores[2] == 0 and scores[1] > 0


def test_damaged(spark):
    files = spark.createDataFrame([("a", b"P5\n3 3\n255\nab"), ("b", images.encoded(PAGE)), ("c", None)], "path string, content binary")
    got = {r["file"]: (r["width"], r["error"] is None) for r in images.parsed(files).collect()}
    assert got == {"a": (None, False), "b": (8, True), "c": (None, False)}
    assert {r["file"] for r in marks.extracted(images.parsed(files)).collect()} == {"b"}


def test_components_at_random():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.4, 0.6, 1.0):
        page = (rng.random((30, 40)) < share).astype(np.uint8)
        seen, want = np.zeros_like(page), []
        for y, x in np.argwhere(page):
            if seen[y, x]:
                continue
            todo, own = [(y, x)], []
            seen[y, x] = 1
            while todo:
                a, b = todo.pop()
                own.append((a, b))
                for c, d in np.argwhere(page[max(a - 1, 0) : a + 2, max(b - 1, 0) : b + 2]):
                    c, d = c + max(a - 1, 0), d + max(b - 1, 0)
                    if not seen[c, d]:
                        seen[c, d] = 1
                        todo.append((c, d))
            want.append((min(b for _, b in own), min(a for a, _ in own), len(own)))
        assert [(x, y, int(b.sum())) for x, y, b in marks.components(page)] == want
    assert list(marks.components(np.zeros((3, 3), np.uint8))) == []


def test_average_and_quadrants():
    a, b, c = (np.array(x, np.uint8) for x in ([[1, 1], [1, 0]], [[1, 1], [1, 1]], [[1, 0], [1, 0]]))
    assert marks.average([a, b, c], [(0, 0)] * 3).tolist() == [[1, 1], [1, 0]]
    assert marks.average([a], [(0, 0)]).tolist() == a.tolist()
    assert marks.quadrants(np.ones((4, 4), np.uint8)) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert marks.overlap_difference(a, c, (0, 0), (0, 0)) == 1


def test_codecs():
    rng = np.random.default_rng(2)
    for share in (0.02, 0.5, 0.97):
        for shape in ((1, 1), (7, 1), (1, 9), (33, 40)):
            page = (rng.random(shape) < share).astype(np.uint8)
            assert (codecs.decode_bilevel(codecs.encode_bilevel(page)) == page).all()
            lossy = page ^ (rng.random(shape) < 0.02)
            raw = codecs.encode_bilevel(page, lossy)
            assert (codecs.decode_bilevel(raw, lossy) == page).all()
    assert len(raw) < len(codecs.encode_bilevel(page)) + 40
    blank = np.zeros((64, 64), np.uint8)
    assert len(codecs.encode_bilevel(blank)) < 40
    for most, shape in ((256, (20, 30)), (4, (40, 7)), (1, (5, 5)), (256, (1, 1)), (256, (1, 5)), (256, (5, 1))):
        grey = rng.integers(0, most, shape).astype(np.uint8)
        assert (codecs.decode_grey(codecs.encode_grey(grey)) == grey).all()
    smooth = (np.add.outer(np.arange(64), np.arange(64)) // 2).astype(np.uint8)
    assert (codecs.decode_grey(codecs.encode_grey(smooth)) == smooth).all() and len(codecs.encode_grey(smooth)) < smooth.size // 2


def test_grey_side_by_side(spark):
    """Strips coded together have the same bits as one by one, and take a fraction of the time."""
    rng = np.random.default_rng(3)
    for most, width in ((256, 1), (256, 2), (40, 3), (3, 17)):
        pages = [(rng.integers(0, most, (int(rng.integers(1, 40)), width)) * (255 // (most - 1))).astype(np.uint8) for _ in range(20)]
        pages += [np.where(rng.random((400, width)) < 0.3, 255, 0).astype(np.uint8), np.zeros((1, 5), np.uint8), np.zeros((0, 5), np.uint8)]
        coded = codecs.encode_greys(pages)
        assert coded == [codecs.encode_grey(p) for p in pages]
        assert all(a.shape == b.shape and (a == b).all() for a, b in zip(codecs.decode_greys(coded), pages, strict=True))
    text = np.frombuffer(b"So many words of plain text, of which each line is a row of pixels; " * 4000, np.uint8)[: 400 * 256].reshape(400, 16, 16)
    began = time.process_time()
    back = codecs.decode_greys(codecs.encode_greys(list(text)))
    together = time.process_time() - began
    one_by_one = [codecs.decode_grey(codecs.encode_grey(p)) for p in text]
    assert (np.array(back) == text).all() and (np.array(one_by_one) == text).all()
    assert 3 * together < time.process_time() - began - together
    rows = [("a", 16, 100, 255, bytearray(text[:100, 0].tobytes())), ("b", 8, 5, 1, bytearray(PAGE.tobytes())), ("c", 16, 3, 255, bytearray(text[0, :3].tobytes()))]
    pages = spark.createDataFrame(rows, "file string, width int, height int, most int, pixels binary")
    found = {r["file"]: (r["width"], r["height"], bytes(r["pixels"])) for r in codecs.decoded(codecs.encoded(codecs.strips(pages, 4))).collect()}
    want = {f"{f}#{k}": (w, min(4, h - 4 * k), bytes(p[4 * k * w : 4 * (k + 1) * w])) for f, w, h, _, p in rows for k in range(-(-h // 4))}
    assert found == want
