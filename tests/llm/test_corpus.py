"""Corpus operators on small tables: edge cases and plain-Python versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from attestra.llm import chat, components, decontaminate, fingerprint, kneser_ney, linededup, mixture, ngramjoin, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, node string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "kept", "kept") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing extra columns."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(60_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two three four five six seven eight nine ten eleven", None), (3, "one two three four five six seven eight nine ten eleven", None), (None, "short text", "b"), (4, long, "b"), (5, long + " tail", "b"), (6, " \n\t\n", "c"), (7, "x", "c"), (7, "y", "c")]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components_match_plain_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5200)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    groups = {}
    for n, r in found.items():
        groups.setdefault(r, set()).add(top(n))
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({top(n) for n in found})


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "TWO three four, five six seven eight nine ten ELEVEN"), (2, "short text"), (3, None), (None, "x"), (4, ""), (2, "short text")], "item_id long, text string")
    rows = decontaminate.decontaminate(odd, items).collect()
    assert len(rows) == 10
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["items"]) for r in rows}
    assert got[(3, 11)] == (10, ["1"]) and got[(None, 2)] == (2, ["2"]) and got[(7, 1)] == (0, [])
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(odd, items.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize(("block", "apart"), [(None, 1), (64, 2 * 64)])
def test_mixture_bounds(spark, odd, empty, block, apart):
    """A source's take is off its target by a slot or two at most; slots are of one word in small tables."""
    rows = mixture.mixed_documents(odd, block=block).collect()
    assert len(rows) == 10 and mixture.mixed_documents(empty).count() == 0
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    per = {}
    for r in rows:
        t = per.setdefault(r["source"], [0, r["target"], r["source_size"]])
        t[0] += r["taken"]
    assert all(abs(t - want) <= apart and want <= 3 * size + 1e-6 for t, want, size in per.values())


def test_fingerprints_match_plain_python(spark, odd, empty):
    rows = fingerprint.with_next(fingerprint.document_fingerprints(odd), ["text", "sketch"], rows_each=2).collect()
    assert len(rows) == 10 and fingerprint.with_next(fingerprint.document_fingerprints(empty), ["text"]).count() == 0
    order = sorted((((-r["doc_id"] if r["doc_id"] is not None else 99), r["text"]) for r in rows))
    after = {}
    for k, x in enumerate(order):
        after.setdefault(x, set()).add(order[(k + 1) % len(order)][1])
    assert all(r["next_text"] in after[((-r["doc_id"] if r["doc_id"] is not None else 99), r["text"])] for r in rows)
    same = [r["sketch"] for r in rows if r["doc_id"] == 3]
    assert same[0] == same[1] and len(same[0]) == 7


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(5, "http://a/é\r\n", "<p>x</p>"), (2, "u", "<p>x</p>"), (7, None, None), (9, "u", ""), (None, "u", "zz"), (4, "u", "<p>x</p>")] + [(100 + i, "u", f"page {i} " * 50) for i in range(60)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in warc.archive_round_trip(pages, f"file://{tmp_path}/w").collect()}
    assert len(rows) == 66
    assert (rows[5]["record_type"], rows[5]["refers_to"], rows[2]["record_type"]) == ("revisit", 2, "response")
    assert (rows[9]["record_type"], rows[9]["refers_to"]) == ("revisit", 7)
    assert rows[4]["payload_digest"] == warc.digest32(b"<p>x</p>") and rows[7]["payload_bytes"] == 0
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    records = [warc.build_record(i, "u", bytes([i]) * i, "D", None, False, "d") for i in range(40)]
    assert list(warc.unpack(warc.pack(records))) == records


def test_toxicity_learns_words_and_scores_odd_rows(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["green", "river", "stone", "cloud"]) for _ in range(30)) + (" vileword" if i % 3 == 0 else ""), "a") for i in range(400)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((scored[i] >= 0.5) == (i % 3 == 0) for i in held)
    out = toxicity.score(odd, model).collect()
    assert len(out) == 10 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(empty, toxicity.fit(docs, labels.limit(0))).count() == 0
    f = toxicity.features("some text of words")
    assert (toxicity.unpack(toxicity.pack(f)) == f).all()


def test_token_counts_match_library(spark, odd):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    from attestra.llm import bpe

    path = public.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    texts = ["It's 12 o'clock <|endoftext|> ΑΣ ½ é", "a\u0085b\u001cc", "<|ENDOFTEXT|>", "　日本語🙂", "", None, "x" * 5000]
    count = bpe.Counter(path).count
    assert [count(t) for t in texts] == [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    rows = bpe.with_token_counts(odd, path).collect()
    assert len(rows) == 10 and {r["n_tokens"] for r in rows if not r["text"]} == {0}


def test_line_classes_match_brute_force(spark, odd, empty):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(90)).strip() for _ in range(6)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(4):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                s[rng.randrange(len(s))] = rng.choice("xyz")
            lines.append("".join(s).strip())
        rows.append((d, "\n".join(lines), "a"))
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in linededup.line_classes(docs_of(spark, rows)).collect()}
    where, sets = {}, {}
    for d, t, _ in rows:
        for i, x in enumerate(t.split("\n")):
            where.setdefault(x, []).append((d, i))
            sets[x] = {x[k : k + 7] for k in range(max(1, len(x) - 6))}
    names = list(where)
    parent = {x: x for x in names}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                parent[top(y)] = top(x)
    classes = {}
    for x in names:
        classes.setdefault(top(x), []).extend(where[x])
    want = {o: min(v) for v in classes.values() for o in v}
    assert set(got) == set(want)
    assert sum(got[k] != want[k] for k in want) <= 0.02 * len(want)
    assert linededup.line_classes(empty).count() == 0
    out = linededup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == 10


def test_near_copies_match_brute_force(spark, odd, empty):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(80)]
        for c in range(rng.choice([1, 3, 9])):
            w = list(base)
            for _ in range(c // 3):
                w[rng.randrange(80)] = rng.choice(words)
            rows.append((len(rows), " ".join(w), "a"))
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(76)} for d, t, _ in rows}
    near = {d: [e for e in sets if e != d and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])] for d in sets}
    out = {r["doc_id"]: r for r in ngramjoin.link_documents(docs_of(spark, rows)).collect()}
    assert {d: out[d]["n_links"] for d in sets} == {d: len(n) for d, n in near.items()}
    for d in sets:
        seen, todo = {d}, [d]
        while todo:
            for e in near[todo.pop()]:
                if e not in seen:
                    seen.add(e)
                    todo.append(e)
        assert out[d]["class_id"] == min(seen)
    odd_rows = ngramjoin.link_documents(odd).collect()
    assert len(odd_rows) == 10 and all(r["n_links"] == 1 and r["class_id"] == 4 for r in odd_rows if r["doc_id"] in (4, 5))
    assert ngramjoin.link_documents(empty).count() == 0


def test_chat_format_and_states(spark):
    said = "a \\ b <|im_end|>\n<|im_start|>assistant ok \\n <\\|"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, "assistant", None), (2, 1, None, "x"), (None, None, "ro\nle", "t")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.format_conversations(turns).collect()}
    assert chat.read_back(out[1]["formatted"]) == [("user", said), ("assistant", said)] and out[1]["valid"]
    assert not out[2]["valid"] and out[2]["bad_turn"] == 0 and chat.read_back(out[None]["formatted"]) == [("ro\nle", "t")]
    d = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    assert d[1]["loss_chars"] == len(said) and d[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.format_conversations(turns.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows", [2_000_000, 40])
def test_kneser_ney_sums_to_one_and_matches_plain_python(spark, odd, empty, shard_rows):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    model = kneser_ney.train(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)]), shard_rows)
    pairs, count, after = {}, {}, {}
    for t in texts:
        v = None
        for w in [*t.split(), "\n"]:
            pairs[v, w] = pairs.get((v, w), 0) + 1
            count[w] = count.get(w, 0) + 1
            v = w
    for v, w in pairs:
        after.setdefault(w, set()).add(v)
    V, types = len(count), len(pairs)
    c = lambda n, xs: sum(x == n for x in xs)
    d1 = kneser_ney._discounts(*[c(n, [len(s) for s in after.values()]) for n in (1, 2, 3, 4)])
    d2 = kneser_ney._discounts(*[c(n, pairs.values()) for n in (1, 2, 3, 4)])
    gamma = sum(d1[min(len(s), 3) - 1] for s in after.values()) / types

    def p(v, w):
        cont = len(after.get(w, ()))
        low = (max(cont - (d1[min(cont, 3) - 1] if cont else 0), 0)) / types + gamma / (V + 1)
        total = sum(n for (x, _), n in pairs.items() if x == v)
        if not total:
            return low
        n = pairs.get((v, w), 0)
        back = sum(d2[min(m, 3) - 1] for (x, _), m in pairs.items() if x == v) / total
        return max(n - (d2[min(n, 3) - 1] if n else 0), 0) / total + back * low

    assert abs(sum(p("a", w) for w in [*count, "unknown"]) - 1) < 1e-9
    probe = ["a b zz c", "", "h g a", None]
    got = {r["doc_id"]: r["score"] for r in kneser_ney.score(docs_of(spark, [(i, t, "a") for i, t in enumerate(probe)]), model).collect()}
    for i, t in enumerate(probe):
        ws = [*(t or "").split(), "\n"]
        want = sum(np.log10(p(v, w)) for v, w in zip([None, *ws[:-1]], ws, strict=True))
        assert abs(got[i] - want) < 1e-6
    assert len(kneser_ney.score(odd, model).collect()) == 10
    assert kneser_ney.score(empty, kneser_ney.train(empty)).count() == 0


@pytest.mark.parametrize("shard_rows", [2_000_000, 40])
def test_kneser_ney_of_order_three_matches_plain_python(spark, empty, shard_rows):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["a b c d"] * 300
    model = kneser_ney.train(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)]), shard_rows, 3)
    level = {1: {}, 2: {}, 3: {}}
    for t in texts:
        ws = [None, *t.split(), "\n"]
        level[2][tuple(ws[:2])] = level[2].get(tuple(ws[:2]), 0) + 1
        for k in range(2, len(ws)):
            g = tuple(ws[k - 2 : k + 1])
            level[3][g] = level[3].get(g, 0) + 1
    for k in (3, 2):
        for g in level[k]:
            level[k - 1][g[1:]] = level[k - 1].get(g[1:], 0) + 1
    d = {k: kneser_ney._discounts(*[sum(n == m for n in level[k].values()) for m in (1, 2, 3, 4)]) for k in level}
    off = lambda k, n: d[k][min(n, 3) - 1] if n else 0
    V = len(level[1])

    def p(ctx, w):
        k = len(ctx) + 1
        row = {g[-1]: n for g, n in level[k].items() if g[:-1] == ctx}
        low = p(ctx[1:], w) if ctx else 1 / (V + 1)
        if not row:
            return low
        return (max(row.get(w, 0) - off(k, row.get(w, 0)), 0) + sum(off(k, n) for n in row.values()) * low) / sum(row.values())

    assert abs(sum(p(("a", "b"), w) for w in [*(g[0] for g in level[1]), "unknown"]) - 1) < 1e-9
    probe = ["a b c d e f", "a b zz c d", "", "h g a", None]
    got = {r["doc_id"]: r["score"] for r in kneser_ney.score(docs_of(spark, [(i, t, "a") for i, t in enumerate(probe)]), model).collect()}
    for i, t in enumerate(probe):
        ws = [None, *(t or "").split(), "\n"]
        assert abs(got[i] - sum(np.log10(p(tuple(ws[max(0, k - 2) : k]), ws[k])) for k in range(1, len(ws)))) < 1e-6
    assert kneser_ney.score(empty, kneser_ney.train(empty, order=3)).count() == 0


def test_short_near_copies_meet_in_the_forest():
    """Eight of ten shingles shared: at the shortest prefix independent values meet in 99.96 of 100 pairs; XOR masks reached 99.4."""
    rng, f, met = np.random.default_rng(1), ngramjoin.factors(), 0
    shape = (-1, ngramjoin.TREES, ngramjoin.DEPTH)
    for _ in range(6000):
        x = rng.integers(0, 1 << 64, 10, np.uint64)
        a, b = (ngramjoin.signature(s, f).reshape(shape) for s in (x[:9], np.delete(x, 8)))
        met += bool((ngramjoin.shared_lengths(a, b[0]) >= ngramjoin.least_length(0.8)).any())
    assert met >= 0.998 * 6000


def test_forest_compares_each_pair_at_its_longest_prefix_only():
    rng, f = np.random.default_rng(2), ngramjoin.factors()
    base = np.unique(rng.integers(0, 1 << 64, 60, np.uint64))
    sets = [np.unique(np.delete(base, k)) for k in range(12)]
    sigs = np.stack([ngramjoin.signature(s, f) for s in sets]).reshape(12, ngramjoin.TREES, ngramjoin.DEPTH)
    links, expected = np.zeros(12, np.int64), 0.0
    for length in range(ngramjoin.DEPTH, ngramjoin.least_length(0.8) - 1, -1):
        for tree in range(ngramjoin.TREES):
            paths = {}
            for k in range(12):
                paths.setdefault(sigs[k, tree, :length].tobytes(), []).append(k)
            for rows in paths.values():
                texts, _, _, sums = ngramjoin.compare_block(np.array(rows), None, sigs, sets, np.ones(12, np.int64), tree, length, 0.8)
                links += texts
                expected += sums[:, ngramjoin.DEPTH - 1].sum()
    assert (links == 11).all() and 66 <= expected <= 66.7  # once a link


def test_forest_goes_on_while_it_has_found_nothing(spark):
    """The only pair of a table shares no path of full depth: it is found at a shorter one."""
    f, rng = ngramjoin.factors(), np.random.default_rng(8)
    words = np.array([f"w{k}" for k in range(5000)])
    for _ in range(2000):
        a = list(rng.choice(words, 60))
        b = [*a[:30], "other", *a[31:]]
        sets = [ngramjoin.shingle_hashes(x, ngramjoin.SHINGLE) for x in (a, b)]
        like = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        x, y = (ngramjoin.signature(s, f).reshape(ngramjoin.TREES, ngramjoin.DEPTH) for s in sets)
        if like >= ngramjoin.LIKENESS and not (x == y).all(1).any() and (x[:, :5] == y[:, :5]).all(1).any():
            break
    else:
        raise AssertionError("no such pair")
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, "quite another text of some words")], "doc_id long, text string")
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngramjoin.link_rows(docs).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
