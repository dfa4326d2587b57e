"""JPEG headers made byte by byte: sizes, EXIF in both byte orders, fill bytes, what breaks off."""

import struct

import pytest

from tillmark.sources import readers


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def exif(orientation, order, before=3):
    mark, e = (b"II", "<") if order == "little" else (b"MM", ">")
    entries = [struct.pack(e + "HHII", 0x0100 + k, 4, 1, 9) for k in range(before)] + [struct.pack(e + "HHIHH", 0x0112, 3, 1, orientation, 0)]
    return segment(0xE1, b"Exif\0\0" + mark + struct.pack(e + "HI", 42, 8) + struct.pack(e + "H", len(entries)) + b"".join(entries) + b"\0\0\0\0")


def jpeg(width, height, *extra, frame=0xC0, end=b"\xff\xd9", data=b"\x12\xff\x00\x34" * 600):
    sof = segment(frame, bytes([8]) + struct.pack(">HH", height, width) + bytes([3]) + bytes(9))
    return b"\xff\xd8" + b"".join(extra) + segment(0xDB, bytes(65)) + sof + segment(0xC4, bytes(20)) + segment(0xDA, bytes(10)) + data + end


FILES = {
    "plain.jpg": (jpeg(800, 700), 700, 0, False, None),
    "small.jpg": (jpeg(800, 300), 300, 0, False, "image too small"),
    "turned.jpg": (jpeg(900, 650, exif(6, "big")), 650, 90, False, None),
    "little.jpeg": (jpeg(650, 900, exif(8, "little")), 650, 270, False, None),
    "mirror.jpg": (jpeg(650, 900, exif(5, "little", 0)), 650, 90, True, None),
    "odd_exif.jpg": (jpeg(650, 900, exif(77, "big")), 650, 0, False, None),
    "other_app.jpg": (jpeg(650, 900, segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + bytes(50)), segment(0xE0, b"JFIF\0" + bytes(9)), b"\xff", exif(3, "big")), 650, 180, False, None),
    "progressive.jpg": (jpeg(1200, 601, frame=0xC2), 601, 0, False, None),
    "no_end.jpg": (jpeg(800, 700, end=b""), 700, 0, False, "not an image"),
    "cut_header.jpg": (b"\xff\xd8" + segment(0xE0, bytes(14)) + b"\xff\xe2\xff\xff" + bytes(2000), None, 0, False, "not an image"),
    "no_frame.jpg": (b"\xff\xd8" + segment(0xDA, bytes(10)) + bytes(2000) + b"\xff\xd9", None, 0, False, "not an image"),
    "noise.jpg": (b"\xff\xd8\xff" + bytes(range(256)) * 8, None, 0, False, "not an image"),
    "end_by_halves.jpg": (jpeg(800, 700, end=b"\x0f\xfd\x90"), 700, 0, False, "not an image"),
}


def test_headers(spark, tmp_path):
    for name, (data, *_) in FILES.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["short_side"], r["turn"], r["mirrored"], r["rejected"]) for r in readers.capture(spark, str(tmp_path)).collect()}
    assert got == {name: want for name, (_, *want) in ((n, (d, *w)) for n, (d, *w) in FILES.items()) for want in [tuple(want)]}


@pytest.mark.parametrize("at", [3, 5, 20, 60, 90, 120, 400])
def test_files_that_break_off(spark, tmp_path, at):
    whole = jpeg(800, 700, exif(6, "big"))
    (tmp_path / "x.jpg").write_bytes(whole[:at] + bytes(max(0, 1100 - at)))
    (row,) = readers.capture(spark, str(tmp_path)).collect()
    assert row["rejected"] == "not an image"
