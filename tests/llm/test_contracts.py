"""The registered queries whose results SQL cannot express, against plain Python over the sample tables."""

import hashlib
import math
import re
import zlib

import duckdb
import pytest
import xxhash

from attestra.llm import bpe, linededup, mixture, queries
from attestra.llm.common import stash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return {i: (t or "", s) for i, t, s in duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()}


def held(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod == 0


def plain_mix(sizes: dict, block: int, repeats: int = 3):
    """(targets, words taken) of sources by plain loops."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        mass = sum(weight[s] for s in free)
        level = (total - sum(capped.values())) / mass if mass else 0
        over = [s for s in free if level * weight[s] > repeats * sizes[s]]
        if not over:
            break
        capped.update({s: repeats * sizes[s] for s in over})
    target = {s: capped.get(s, level * weight[s]) for s in names}
    upto, cuts = 0.0, []
    for s in names:
        upto += target[s]
        cuts.append((upto, s))
    slots = dict.fromkeys(names, 0)
    for k in range(-(-total // block)):
        x = (k * (math.sqrt(5) - 1) / 2) % 1.0 * upto
        slots[next((s for u, s in cuts if x < u), names[-1])] += 1
    return target, {s: min(slots[s] * block, repeats * sizes[s]) for s in names}


def test_mixture_takes_what_its_slots_say(spark, documents):
    sizes = {}
    for text, source in documents.values():
        sizes[source] = sizes.get(source, 0) + len([w for w in re.split(r"[\x20\x09-\x0D]+", text) if w])
    for block in (None, 50):
        target, want = plain_mix(sizes, block or max(1, min(mixture.BLOCK, sum(sizes.values()) // mixture.SLOTS)))
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        rows = mixture.mixed_documents(docs, block=block).collect()
        got, seen = {}, {}
        for r in rows:
            got[r["source"]] = got.get(r["source"], 0) + r["taken"]
            seen[r["source"]] = r["target"]
            assert 0 <= r["taken"] <= 3 * r["size"]
        assert got == want and all(abs(seen[s] - t) < 1e-6 for s, t in target.items())
    _, segments = mixture.mix(docs, block=50)
    places = segments.groupBy("slot").agg({"n_words": "sum", "source": "min", "rank": "max"}).collect()
    assert len({r["slot"] for r in places}) == len(places) and max(r["sum(n_words)"] for r in places) <= 50
    assert segments.groupBy("slot").agg({"rank": "min"}).join(segments.groupBy("slot").agg({"rank": "max"}), "slot").where("`min(rank)` <> `max(rank)`").count() == 0


def test_mixture_of_nothing_but_empty_texts_and_of_null_beside_empty_source(spark):
    kind = "doc_id long, text string, source string"
    rows = mixture.mixed_documents(spark.createDataFrame([(1, "", "a"), (2, None, None), (3, " ", "a")], kind)).collect()
    assert len(rows) == 3 and all(r["taken"] == 0 and r["target"] == 0 for r in rows)
    rows = mixture.mixed_documents(spark.createDataFrame([(1, "x " * 40, ""), (2, "y " * 40, None), (2, "y " * 40, None)], kind)).collect()
    assert {(r["source"], r["source_size"]) for r in rows} == {("", 40), (None, 80)}


def _chain(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v % (1 << 64)).to_bytes(8, "little"), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def plain_sketch(text: str, keep: int = 128, shingle: int = 5):
    h = [_chain(w.encode()) for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    if not h:
        return []
    if len(h) < shingle:
        seed = 42
        for v in h:
            seed = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed)
        return [seed - (1 << 64) if seed >= 1 << 63 else seed]
    grams, width = h, 1
    while width < shingle:
        by = min(width, shingle - width)
        grams, width = [_chain(grams[k], grams[k + by]) for k in range(len(grams) - by)], width + by
    return sorted(set(grams))[:keep]


def plain_likeness(a, b, keep: int = 128):
    if not a and not b:
        return 1.0
    both = sorted(set(a) | set(b))[:keep]
    return len(set(both) & set(a) & set(b)) / len(both)


def test_fingerprints_match_plain_sketches(spark, documents):
    got = {r["doc_id"]: r for r in queries.op3_document_fingerprints(spark, SF).collect()}
    order = sorted(documents, reverse=True)
    assert len(got) == len(order)
    for k, d in enumerate(order):
        text, after = documents[d][0], documents[order[(k + 1) % len(order)]][0]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, e, n = plain_sketch(text), plain_sketch(edited), plain_sketch(after)
        name = "".join(f"{h % (1 << 64):016X}" for h in a)
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), name)
        assert abs(r["near_edited"] - plain_likeness(a, e)) < 1e-9 and abs(r["near_next"] - plain_likeness(a, n)) < 1e-9


def test_toxicity_ranks_held_out_rows(spark):
    out = {r["doc_id"]: r for r in queries.op5_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = dict(duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet'").fetchall())
    assert all(r["held_out"] == held(d, 5) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in out.items())
    mine = [(out[d]["score"], t) for d, t in labels.items() if d in out and held(d, 5)]
    pos, neg = [s for s, t in mine if t == 1], [s for s, t in mine if t == 0]
    assert len(pos) > 30
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.8  # an eighth of the labels names texts with nothing in common


def test_token_counts_match_the_library_on_the_sample_table(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = dict(duckdb.sql("select doc_id, coalesce(text, '') from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.with_token_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), path).collect()}
    assert got == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}


def test_line_dedup_reaches_recall_on_documents(spark):
    """Lines of every 20th document against all lines: a pair at 0.8 or more lands in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = stash(linededup.line_classes(docs), "classes").collect()
    texts = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    kept, of_line = {}, {}
    for r in rows:
        line = (texts[r["doc_id"]] or "").split("\n")[r["line_no"]].strip(" \t\r\x0b\f")
        of_line[line] = (r["keep_doc_id"], r["keep_line_no"])
        kept.setdefault(of_line[line], []).append(line)
    k = linededup.SHINGLE
    sets = {x: {x[j : j + k] for j in range(max(1, len(x) - k + 1))} for x in of_line}
    where = {}
    for x, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(x)
    asked = {(texts[d] or "").split("\n")[n].strip(" \t\r\x0b\f") for d, n in ((r["doc_id"], r["line_no"]) for r in rows) if d % 20 == 0}
    met = all_ = 0
    for x in asked:
        shared = {}
        for g in sets[x]:
            for y in where[g]:
                shared[y] = shared.get(y, 0) + 1
        for y, n in shared.items():
            if y != x and n >= 0.8 * (len(sets[x]) + len(sets[y]) - n):
                all_ += 1
                met += of_line[x] == of_line[y]
    assert all_ > 20 and met >= 0.98 * all_


def test_language_model_counts_match_plain_python(spark, documents):
    count, total = {}, 0
    tokens = {d: [*(w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if w), "\n"] for d, (t, _) in documents.items()}
    for d, ws in tokens.items():
        if not held(d, 10):
            total += len(ws)
            for w in ws:
                count[w] = count.get(w, 0) + 1
    for r in queries.op10_kneser_ney(spark, SF).collect():
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((count.get(w, 0) + 0.1) / (total + 0.1 * (len(count) + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"], 10), len(ws), sum(w in count for w in ws), total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and abs(r["perplexity"] - 10 ** (-r["score"] / len(ws))) < 1e-6 * r["perplexity"]
