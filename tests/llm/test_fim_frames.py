import hashlib
import random
import re

import pytest

from shelfcast.llm import fim_frames as ff

from .edge import LONG, ROWS, frame

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """The contract on a string, without frames."""
    text = text or ""
    units = UNIT.findall(text)
    hexa = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexa[i : i + 8], 16) for i in (0, 8, 16, 24)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, sha(text), sha(text), text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return len(units), form, len(p), len(m), sha(out), sha(text), out


def some_text(rng, n):
    return "".join(rng.choice(["a", "word", "é", "中文", "😀", " ", "  ", "\n\t", "\x0b", " ", "\x1c", "<P", "<S"]) for _ in range(n))


def test_frames_hold_the_text_and_its_counts():
    rng = random.Random(1)
    for n in (0, 1, 5, 60, 800):
        for size in (1, 7, 64, 1 << 14):
            text = some_text(rng, n)
            made = ff.Frames.of(ff.pieces(text.encode(), size))
            assert b"".join(made.stream()).decode() == text
            units = UNIT.findall(text)
            assert made.total(made.units) == len(units) and made.total(made.chars) == len(text)
            for i in range(len(made.frames)):
                # every frame ends where a unit ends
                part = b"".join(made.slice(0, i + 1).stream()).decode()
                assert part == "".join(units[: made.units[i]]) and len(part) == made.chars[i]
            for k in range(len(units) + 1):
                left, right = made.cut(k)
                assert b"".join(left.stream()).decode() == "".join(units[:k])
                assert b"".join((left + right).stream()).decode() == text
                assert left.total(left.units) == k and (left + right).units[-1:] == ([len(units)] if units else [])


def test_only_the_cut_frame_is_decompressed(monkeypatch):
    made = ff.Frames.of(ff.pieces(b"some words of a text " * 500, 100))
    opened, (compress, decompress) = [], ff._zstd()
    monkeypatch.setattr(ff, "_zstd", lambda: (compress, lambda f: opened.append(f) or decompress(f)))
    made.cut(made.units[3])
    assert not opened
    left, _ = made.cut(made.units[3] + 1)
    assert opened == [made.frames[4]] and left.frames[:4] == made.frames[:4]
    opened.clear()
    assert len(b"".join(made.stream(made.bytes[2], made.bytes[4]))) == made.bytes[4] - made.bytes[2]
    assert len(opened) == 2


def test_marks_across_frames():
    made = ff.Frames.of(iter([b"<P>ab<", b"S>c<", b"M", b">d"]))
    assert made.find([b"<P>", b"<S>", b"<M>"]) == [0, 5, 9]
    assert b"".join(ff.restored(made, "psm")) == b"abdc"


@pytest.mark.parametrize("size", [3, 40, 1 << 14])
def test_as_the_contract_on_strings(spark, size):
    rng = random.Random(size)
    rows = [(i, some_text(rng, rng.randrange(120)), "en", "s", 0) for i in range(150)]
    rows += [(200, "a <P> b c", "en", "s", 0), (201, "x" * 5000, "en", "s", 0), (202, " " * 300, "en", "s", 0)] + ROWS
    packed = ff.pack(frame(spark, rows), ["doc_id"], frame=size)
    got = ff.transform(packed, ["doc_id"], output=True).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(key((r[0], *plain(r[0], r[1]))) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_no_rows_other_draws_and_units(spark):
    assert ff.transform(ff.pack(frame(spark, []), ["doc_id"]), ["doc_id"]).count() == 0
    packed = ff.pack(frame(spark, [(1, "one two  three ", "en", "s", 0), (2, None, "en", "s", 0), (3, LONG, "en", "s", 0)]), ["doc_id"], frame=1000)
    got = {r.doc_id: r.part for r in ff.units_between(packed, ["doc_id"], 1, 3).collect()}
    assert got == {1: " two  three", 2: "", 3: " Beta gamma"}
    assert {r.doc_id: r.part for r in ff.units_between(packed, ["doc_id"], 3, 3).collect()}[1] == ""
    packed = ff.pack(frame(spark, [(i, "one two three four", "en", "s", 0) for i in range(40)]), ["doc_id"])
    a, b = (ff.transform(packed, ["doc_id"], seed=s).orderBy("doc_id").collect() for s in (42, 43))
    assert a != b and a == ff.transform(packed, ["doc_id"]).orderBy("doc_id").collect()
