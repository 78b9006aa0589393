"""The corpus pipeline against a plain-Python version of its stages, on a small fixture."""

import random
import re
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def alike(x, y):
    return len(x & y) >= 0.8 * len(x | y)


def components(names, linked):
    parent = {n: n for n in names}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            if linked(x, y):
                parent[top(y)] = top(x)
    return {n: top(n) for n in names}


def plain_line_dedup(rows):
    where = {}
    for d, t in sorted(rows.items()):
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\x0b\f"):
                where.setdefault(line.strip(" \t\r\x0b\f"), []).append((d, i))
    sets = {x: {x[k : k + 7] for k in range(max(1, len(x) - 6))} for x in where}
    top = components(list(where), lambda x, y: alike(sets[x], sets[y]))
    groups = {}
    for x, places in where.items():
        groups.setdefault(top[x], []).extend(places)
    gone = {p for places in groups.values() for p in places if p != min(places)}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows.items()}


def plain_near_copies(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(t) for d, t in rows.items()}
    top = components(sorted(rows), lambda x, y: bool(sets[x]) and bool(sets[y]) and alike(sets[x], sets[y]))
    first = {}
    for d in sorted(rows):
        first.setdefault(top[d], d)
    return {d: t for d, t in rows.items() if first[top[d]] == d}


def plain_decontaminate(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))

    windows = {}
    for t in items:
        w = words(t)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(k, set()).add(tuple(w[s : s + k]))

    def hit(t):
        w = words(t)
        return any(tuple(w[s : s + k]) in found for k, found in windows.items() for s in range(len(w) - k + 1))

    return {d: t for d, t in rows.items() if not hit(t)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    words = [f"word{rng.randrange(10**6)}" for _ in range(900)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 12, 30)]

    def line():
        return " ".join(rng.choice(words) for _ in range(9))

    shared = line()
    texts = []
    for d in range(90):
        lines = [line() for _ in range(5)]
        if d % 9 == 0:
            lines.insert(2, shared + str(d))
        if d % 15 == 4:
            lines.insert(1, items[d % 3])
        if d % 4 == 1:
            lines[0] += " vile scum filth"
        texts.append("\n".join(lines))
    texts[40] = texts[10]
    # a near copy whose lines differ too much for line dedup: line breaks stand elsewhere
    texts[50] = texts[11].replace("\n", " ")
    texts[60], texts[61] = None, ""
    rows = [(d, t, "en", "ab"[d % 2] if d % 7 else None, len(t or "")) for d, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d % 4 == 1)) for d in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages_match_plain_python(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    def deduped(rows):  # a document that loses all its lines goes
        return {d: t for d, t in plain_line_dedup(rows).items() if (t or "").strip() or not (rows[d] or "").strip()}

    plain = [None, deduped, plain_near_copies, lambda rows: plain_decontaminate(rows, items), None]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = corpus_pipeline.stash(stage(spark, docs, path), "test")
        if name.startswith("mixing"):
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == set(before) and len(rows) == len(before)
            size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in before.items()}
            assert all(r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in rows)
            continue
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.count() == len(after)
        if want is None:
            held = [d for d in before if zlib.crc32(str(d).encode()) % 5 == 0]
            toxic = {d for d in held if "vile" in (before[d] or "")}
            assert len(toxic & set(after)) <= 0.2 * len(toxic)
            assert len((set(held) - toxic) & set(after)) >= 0.8 * len(set(held) - toxic)
        else:
            assert after == want(before)
            assert after != before
        docs = out


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert 0 < out.count() < 90


def test_near_copies_leave_one_row_with_null_ids_and_repeated_rows(spark):
    w = [f"w{i}" for i in range(60)]
    a, b, c, d, e = (" ".join(x + y for y in w) for x in "abcde")
    rows = [(None, a), (None, a), (None, a + " end"), (1, b), (None, b), (2, c), (2, c), (2, c), (3, d), (3, d + " end"), (4, e), (None, None), (None, None), (5, ""), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sum((t or "").startswith("aw0") for _, t in got) == 1 and sum((t or "").startswith("dw0") for _, t in got) == 1
    assert sorted((i for i, t in got if t and t[0] in "bce")) == [1, 2, 4]
    assert sum(not t for _, t in got) == 4 and len(got) == 9


def test_stages_take_empty_tables_and_nulls_in_any_column(spark, folder):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, None), (1, None, "en", None, 3), (1, None, "en", None, 3)], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), folder[0]).count() == 0, name
        assert stage(spark, odd, folder[0]).count() == 4, name
