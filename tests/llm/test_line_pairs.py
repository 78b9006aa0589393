"""Line dedup: pairs are compared once, bitmaps come before sets, signatures do not depend on how shingles are dealt to rows."""

import random

from attestra.llm import linededup


def near_lines(n):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(150)).strip() for _ in range(8)]
    out = []
    for k in range(n):
        s = list(base[k % 8])
        for _ in range(k % 5):
            s[rng.randrange(5, len(s) - 5)] = rng.choice("xyz")
        out.append("".join(s))
    return out


def test_a_pair_is_compared_once_and_only_where_bitmaps_allow_it(spark, monkeypatch):
    kept, real = {}, linededup.stash
    monkeypatch.setattr(linededup, "stash", lambda df, what="stash": kept.setdefault(what, []).append(real(df, what)) or kept[what][-1])
    linededup.line_classes(spark.createDataFrame(list(enumerate(near_lines(80))), "doc_id long, text string")).count()
    pairs = [(r["x"], r["y"]) for r in kept["pairs"][0].collect()]
    near = {(r["x"], r["y"]) for r in kept["near"][0].collect()}
    links = {(r["x"], r["y"]) for r in kept["links"][0].collect()}
    assert len(pairs) == len({frozenset(p) for p in pairs}) > 20
    assert links <= near <= set(pairs) and links


def test_signatures_do_not_depend_on_the_stride(spark, monkeypatch):
    lines = linededup.lines_of(spark.createDataFrame([(1, "\n".join(["a", "abcdefg", "abcdefgh", "日本語🙂", *near_lines(10)]))], "doc_id long, text string"))
    found = []
    for stride in (2, 3, 8):
        monkeypatch.setattr(linededup, "STRIDE", stride)
        found.append(sorted(map(tuple, linededup.band_keys(lines).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 14 * linededup.BANDS


def test_lines_are_trimmed_at_both_ends(spark):
    text = "  a b \t\n\x0bc\n\x0c\r\nd\r\n e"
    assert [(r["line_no"], r["line"]) for r in linededup.lines_of(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line_no").collect()] == [(0, "a b"), (1, "c"), (3, "d"), (4, " e")]
