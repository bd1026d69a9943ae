"""The corpus operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timeweave.llm import cdc, decontam, minhash, mixing, ordinal, ppm_lang, queries, secrets, simhash, token_rollup, warc
from timeweave.llm.common import shared_dir, word_count
from timeweave.llm.graph import components
from timeweave.llm.textkernel import documents_words, shingle_hashes

SF = "/root/testdata/sf0.001"
docs_table = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def vocabulary(rng, n=4000):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def near_copies(seed=3, groups=12, singles=60):
    """Groups of edited copies around the threshold, chains of copies, and unrelated texts."""
    rng = random.Random(seed)
    words, texts = vocabulary(rng), []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(2, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
            if rng.random() < 0.2:
                base = copy
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(singles)]
    texts += [texts[0]] * 5
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_components_equal_brute_force(spark, width):
    texts = near_copies(width)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=width).collect()}
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {k: r["component_id"] for k, r in got.items()} == {k: find(k) for k in got}
    assert all(got[k]["n_shingles"] == len(sets[k]) for k in got)


def test_densified_signatures_estimate_likeness():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    b = np.unique(np.concatenate((a[:240], rng.integers(0, 2**63, 60).astype(np.uint64))))
    probes = minhash.probe_orders(200)
    same = (minhash.one_permutation(a, 200, probes) == minhash.one_permutation(b, 200, probes)).mean()
    assert abs(same - 240 / 360) < 0.12


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (503, 501), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 503: 500}


def test_word_kernel_splits_like_bytes_split():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abÉé \t\n\x0b\x0c\r.") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["A b " * 400_000]
    seen = {}
    for row, hashes, starts, ends in documents_words(pa.array(texts)):
        raw = texts[row].encode()
        assert [raw[s:e] for s, e in zip(starts, ends)] == raw.split()
        for h, w in zip(hashes.tolist(), raw.lower().split()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(shingle_hashes(np.array([5], np.uint64), 2)) == 1


def test_word_count_expression(spark):
    texts = ["", None, "a", " a  b\t\nc ", " x y", "é è"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", word_count(F.col("text")).alias("n")).collect()
    assert all(r["n"] == len((r["text"] or "").encode().split()) for r in rows)


def smith_waterman(a, b):
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b, 1):
            now.append(max(0, before[j - 1] + (2 if x == y else -1), before[j] - 1, now[j - 1] - 1))
        best, before = max(best, *now), now
    return best


def test_alignment_equals_plain_recursion():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64)
        score, first, last, same = decontam.align(a, b)
        assert score == smith_waterman(a.tolist(), b.tolist())
        if score:
            assert score == smith_waterman(a.tolist(), b[first : last + 1].tolist()) and same <= last - first + 1


def test_edited_leaks_are_found_and_others_are_not(spark):
    rng = random.Random(9)
    words = vocabulary(rng)
    items = [[rng.choice(words) for _ in range(rng.randint(20, 50))] for _ in range(30)]
    rows, want = [], set()
    for k in range(200):
        text = [rng.choice(words) for _ in range(rng.randint(50, 400))]
        if k % 4 == 0:
            item = list(items[k % 30])
            for _ in range(len(item) // 8):
                at = rng.randrange(len(item))
                item[at : at + 1] = rng.choice([[], [rng.choice(words)], [item[at], rng.choice(words)]])
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() + "," for w in item]
            want.add((k, k % 30))
        rows.append((k, " ".join(text)))
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    blocked = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench, block_words=200).collect()}
    assert got == want == blocked
    assert decontam.drop_leaking(docs, bench).count() == 200 - len(want)


def test_rollup_is_idempotent_and_signed(spark):
    rollup = token_rollup.Rollup(spark, shared_dir(spark, "rollup"))
    rows = [("insert", "a", "en", "v1", 5), ("insert", "a", "en", "v1", 7), ("insert", "b", None, "v1", None)]
    schema = "op string, source string, lang string, tokenizer string, n_tokens long"
    first = spark.createDataFrame(rows, schema)
    assert rollup.commit("1", first) and not rollup.commit("1", first)
    revised = spark.createDataFrame([("revise", "c", "en", "v1", 9, "a", "en", 7)], schema + ", old_source string, old_lang string, old_tokens long")
    assert rollup.commit("2", revised)
    assert rollup.commit("3", spark.createDataFrame([("delete", "b", None, "v1", None)], schema))
    want = {("a", "en", "v1", 1, 5), ("c", "en", "v1", 1, 9)}
    assert {tuple(r) for r in rollup.totals().collect()} == want
    rollup.compact(into := shared_dir(spark, "rollup"))
    folded = token_rollup.Rollup(spark, into)
    assert not folded.commit("1", first) and not folded.commit("3", first)
    assert {tuple(r) for r in folded.totals().collect()} == want
    assert folded.commit("4", first)
    folded.compact(again := shared_dir(spark, "rollup"))
    assert not any(token_rollup.Rollup(spark, again).commit(k, first) for k in ("1", "4"))
    with pytest.raises(ValueError):
        rollup.commit("../x", first)
    with pytest.raises(Exception, match="unknown op"):
        token_rollup.deltas(spark.createDataFrame([("upsert", "a", "en", "v", 1)], schema)).collect()


def test_half_written_batch_is_not_counted(spark):
    path = shared_dir(spark, "rollup")
    rollup = token_rollup.Rollup(spark, path)
    change = spark.createDataFrame([("insert", "a", "en", "v1", 5)], "op string, source string, lang string, tokenizer string, n_tokens long")
    token_rollup.deltas(change).write.parquet(f"{path}/batch=1")
    os.remove(f"{path.removeprefix('file://')}/batch=1/_SUCCESS")
    assert rollup.totals().count() == 0
    assert rollup.commit("1", change) and rollup.totals().first()["n_tokens"] == 5


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"), reason="needs a vocabulary file")
def test_bpe_counts(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    out = token_rollup.bpe_counted(docs, "/opt/tokenizers/byte_bpe_50k.tiktoken", r"\S+|\s+", "bpe").collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out}[2] == 0 and out[0]["n_tokens"] >= 2


def test_warc_round_trip(spark):
    big = "é" * 100_000
    nasty = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 4000
    rows = [(1, big), (2, "x" * 99), (3, "x" * 99), (4, big), (5, None), (6, nasty), (None, "q" * 200), (7, "q" * 200), (8, "€" * 70_001)]
    path = shared_dir(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, html string"), path)
    chunks = warc.read_chunks(spark, path)
    got = {r["page_id"]: r for r in warc.records(chunks).collect()}
    for page, html in rows:
        raw = (html or "").encode()
        assert got[page]["payload_digest"] == hashlib.sha256(raw).hexdigest() and got[page]["payload_bytes"] == len(raw) and got[page]["intact"]
    assert {p: r["refers_to"] for p, r in got.items() if r["record_type"] == "revisit"} == {4: 1}
    whole = collections.defaultdict(bytes)
    for r in chunks.orderBy("page_id", "segment", "chunk_no").collect():
        assert len(r["payload"]) <= warc.CHUNK_BYTES
        whole[r["page_id"]] += bytes(r["payload"])
    assert whole[6] == nasty.encode() and whole[8].decode() == "€" * 70_001
    lost = warc.records(chunks.where("not (page_id = 6 and segment = 2)"))
    assert {r["page_id"] for r in lost.where("not intact").collect()} == {6}


def test_warc_reads_members_and_plain_files():
    import gzip

    text = [t.encode() + b"\r\n" for p in range(3) for t in warc.records_of(p, "http://x y", b"abc" * p, None, f"r{p}", 4)]
    for content in (b"".join(text), b"".join(gzip.compress(t) for t in text), gzip.compress(b"".join(text))):
        rows = list(warc.parse(memoryview(content)))
        assert [(r[1], r[4], bytes(r[-1])) for r in rows] == [(0, 1, b""), (1, 1, b"abc"), (2, 1, b"abca"), (2, 2, b"bc")]


def test_foreign_records_come_in_chunks_and_damage_is_marked(spark):
    def record(name, payload, length=None, digest=None):
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{name}>\r\n" + (f"WARC-Payload-Digest: {digest}\r\n" if digest else "")
        return f"{head}Content-Length: {len(payload) if length is None else length}\r\n\r\n".encode() + payload + b"\r\n\r\n"

    big = bytes(range(256)) * 40
    right = "sha256:" + hashlib.sha256(big).hexdigest()
    content = record("big", big, digest=right) + record("wrong", b"abc", digest=right) + b"junk\r\n\r\n" + record("none", b"x" * 2500)
    content += record("short", b"y" * 10, length=4) + record("next", b"z", digest="sha1:ABC") + record("cut", b"q" * 50, length=5000)
    rows = list(warc.parse(memoryview(content), 1000))
    assert max(len(r[-1]) for r in rows) <= 1000
    assert b"".join(r[-1] for r in rows if r[0] == "big") == big and [r[6] for r in rows if r[0] == "big"] == list(range(1, 12))
    running = hashlib.sha256()
    for r in rows:
        if r[0] == "big":
            running.update(r[-1])
            assert r[10] == running.hexdigest()
    frame = spark.createDataFrame(rows, warc.CHUNKS)
    got = {(r["record_type"], r["payload_bytes"], r["payload_digest"]): r["intact"] for r in warc.records(frame).collect()}
    want = {("response", len(big), right[7:]): True, ("response", 3, right[7:]): False, ("damaged", 0, None): False, ("response", 2500, None): True}
    want |= {("response", 4, None): False, ("response", 1, None): True, ("response", 5000, None): False}
    assert got == want
    broken = __import__("gzip").compress(record("a", b"abc"))[:-12]
    assert any(r[11] for r in warc.parse(memoryview(broken)))


def test_gear_cuts_by_definition_and_shift_resistance():
    x = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    gear = cdc._GEAR.astype(object)
    plain = [i + 1 for i in range(31, 3000) if (sum(int(gear[x[i - k]]) << k for k in range(32)) % 2**32) >> 27 == 0]
    assert [int(c) for c in cdc.cut_candidates(x) if c >= 32] == plain

    def chunks(data):
        ends = cdc.chunk_ends([c for c in cdc.cut_candidates(data).tolist() if c >= 32], data)
        return [data[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    own = chunks(x)
    assert b"".join(own) == x.tobytes() and max(map(len, own)) <= cdc.MAX_CHUNK
    moved = chunks(np.concatenate((x[:500], x[:7], x[500:])))
    assert len(set(own) & set(moved)) > 0.8 * len(own)
    again = [chunks(np.frombuffer((p + "la " * 200).encode(), np.uint8)) for p in ("one ", "another beginning ")]
    assert set(again[0][1:-1]) & set(again[1][1:-1])


def longest_shared(texts):
    """{document: positions of bytes in runs of 50 words that another document holds} by comparing all runs."""
    runs = collections.defaultdict(set)
    for d, t in texts.items():
        w = t.split(" ")
        for i in range(len(w) - 49):
            runs[tuple(w[i : i + 50])].add(d)
    out = {}
    for d, t in texts.items():
        w, inside = t.split(" "), set()
        for i in range(len(w) - 49):
            if len(runs[tuple(w[i : i + 50])]) > 1:
                start = sum(len(x) + 1 for x in w[:i])
                inside.update(range(start, start + len(" ".join(w[i : i + 50]))))
        if inside:
            out[d] = inside
    return out


def test_spans_equal_all_runs_and_every_passage_is_left_somewhere(spark):
    rng = random.Random(15)
    words = vocabulary(rng)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = {k: make(rng.randint(40, 200)) for k in range(40)}
    for _ in range(12):
        passage = make(rng.choice([30, 51, 60, 120]))
        for k in rng.sample(range(40), rng.randint(2, 4)):
            w = texts[k].split(" ")
            at = rng.randrange(len(w))
            texts[k] = " ".join([*w[:at], passage, *w[at:]])
    passage = make(120)
    half = " ".join(passage.split(" ")[:60])
    texts |= {41: f"{make(20)} {half} {make(20)}", 45: f"{make(20)} {passage} {make(20)}", 49: f"{make(30)} {passage} {make(9)}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("_id", F.lit("own"))
    want = longest_shared(texts)
    got = {r["doc_id"]: r["spans"] for r in cdc.repeats(docs).collect()}
    assert set(got) == set(want)
    for d, inside in want.items():
        found = set()
        for span in got[d].split(","):
            a, b = map(int, span.split(":"))
            found.update(range(a, b))
        assert inside <= found and len(found - inside) <= 40 * len(got[d].split(","))
    left = {r["doc_id"]: r["text"] for r in cdc.remove_repeats(docs).collect()}
    assert cdc.remove_repeats(docs).columns == docs.columns
    for _, raw, ends in cdc._texts(pa.array(list(texts.values()))):
        for start, end in zip([0, *ends], ends):
            piece = raw[start:end].tobytes().decode()
            assert any(piece in t for t in left.values())
    assert passage in left[45] or half in left[41]


@pytest.mark.parametrize("letters", [2, 3])
def test_passages_of_short_words_are_found(spark, letters):
    """52 words of two or three letters, each passage in two documents of longer words, against all runs of 50."""
    rng = random.Random(21 + letters)
    word = lambda k: "".join(rng.choice(string.ascii_lowercase) for _ in range(k))
    make = lambda n, k: " ".join(word(k) for _ in range(n))
    texts = {}
    for i in range(400):
        passage = make(52, letters)
        texts |= {2 * i + k: f"{make(rng.randint(20, 90), 5)} {passage} {make(rng.randint(20, 90), 6)}" for k in (0, 1)}
    texts |= {1000 + i: make(150, letters) for i in range(100)}
    found = {r["doc_id"] for r in cdc.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = set(longest_shared(texts))
    assert want == set(range(800)) and found <= want and len(found) >= 0.98 * len(want)


def plain_secrets(text):
    out = []
    for kind, pattern, least, group in (("assign", secrets.ASSIGN, 6, 2), ("access", secrets.ACCESS, 20, 0), ("hex", secrets.HEX, 24, 0)):
        at = 0
        while found := pattern.search(text, at):
            at = found.end()
            if len(found[group]) >= least:
                out.append((found.start(), found.end(), kind))
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_secret_spans_equal_a_plain_scan(spark):
    rng = random.Random(6)
    parts = ["Password: 'hunter22'", "API_KEY=abc", "apikey = Zx9+/_.=-q", "AKIA" + "A1B2C3D4E5F6G7H8", "AKIA123", "deadbeef" * 3, "deadbee" * 3, "é", " ", "TOKEN\"  : \"abcdef\"", "ſecret=abcdefgh"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(150)] + [None]
    model = secrets.train(secrets.seeded_random(), [b"thequickbrownfox" * 3] * 50)
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model=model).collect()
    for r in rows:
        base = plain_secrets(texts[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, _, k in base) for kind in secrets.KINDS[:3])


def test_markov_pair_separates_random_from_ordinary():
    rng = random.Random(7)
    words = ["user", "account", "name", "index", "value", "update", "record", "parse", "find", "next", "config", "file", "path"]
    plain = ["".join(rng.choice(words) for _ in range(5)).encode() for _ in range(400)]
    keys = secrets.seeded_random(400, seed=99)
    model = secrets.train(secrets.seeded_random(), plain[:200])
    assert sum(model.score(t) >= secrets.BITS_PER_CHAR for t in keys) > 390
    assert sum(model.score(t) >= secrets.BITS_PER_CHAR for t in plain[200:]) == 0


def test_simhash_near_counts_equal_brute_force(spark):
    rng = random.Random(8)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 20)):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    fps = sorted(fps)
    for radius in (0, 3, 5):
        got = {r["fp"]: r["n_near"] for r in simhash.near_counts(spark.createDataFrame([(f,) for f in fps], "fp long"), radius).collect()}
        want = {a: sum(a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius for b in fps) for a in fps}
        assert got == want


@docs_table
def test_simhash_query_against_plain_python(spark):
    rows = {r["doc_id"]: r for r in queries.op6_simhash(spark, SF).collect()}
    texts = sorted(((r["doc_id"], r["text"]) for r in documents(spark).collect()), reverse=True)
    for (doc, text), (after, follow) in zip(texts, texts[1:] + texts[:1]):
        cut = len(text) // 2
        edited = text[: len(text) - cut] + follow[:cut]
        r = rows[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        bits = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        assert r["near_edited"] == bits(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == bits(r["fingerprint"], rows[after]["fingerprint"])
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows.values()]) > 0.9


def test_water_fill():
    assert mixing.water_fill([100, 100], [5, 2], 1.5, 2) == [200.0, 100.0]
    assert mixing.water_fill([10, 10, 1000], [5, 2, 1], 1.5, 2) == [20.0, 20.0, 1490.0]
    assert mixing.water_fill([0, 0], [5, 2], 1.5, 2) == [0.0, 0.0] and mixing.water_fill([], [], 1.5, 2) == []


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_index_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))


@docs_table
def test_mix_contract(spark):
    docs = documents(spark)
    rows = mixing.document_shares(mixing.mix_plan(docs)).collect()
    again = mixing.document_shares(mixing.mix_plan(docs.repartition(5))).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target = collections.Counter(), {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1
    assert all(abs(taken[s] - t) < 0.08 * t for s, t in target.items())


@docs_table
def test_mixed_blocks_hold_the_words_of_their_documents(spark):
    docs = documents(spark)
    blocks = mixing.mixed_blocks(mixing.mix_plan(docs), docs).collect()
    text = {r["doc_id"]: " ".join((r["text"] or "").split()) for r in docs.collect()}
    assert all(len(b["text"].split()) == b["n_words"] <= mixing.BLOCK for b in blocks)
    assert all(b["text"] in " ".join(text[d] for d in b["doc_ids"]) for b in blocks[:300])
    assert len({(b["shard"], b["slot"]) for b in blocks}) == len(blocks)


def orders(grams, share=2e-5):
    """Counts by order of {(lang, four bytes): n}, of the contexts that a tree holds."""
    out = collections.Counter()
    for (lang, gram), n in grams.items():
        for order in range(4):
            out[lang, order, gram & ((1 << 8 * (order + 1)) - 1)] += n
    sizes, totals = collections.Counter(), collections.Counter()
    for (lang, order, gram), n in out.items():
        sizes[lang, order, gram >> 8] += n
        totals[lang] += n if order == 0 else 0
    out = {k: n for k, n in out.items() if k[1] == 0 or sizes[k[0], k[1], k[2] >> 8] >= max(2, share * totals[k[0]])}
    return pa.table({"lang": [k[0] for k in out], "order": [k[1] for k in out], "gram": [k[2] for k in out], "n": list(out.values())})


def plain_bits(text, grams, share):
    """Code length of a text by the recursion itself: method C with exclusion, contexts by their share."""
    total, bits = sum(grams.values()), 0.0
    below = collections.defaultdict(collections.Counter)
    for gram, n in grams.items():
        raw = gram.to_bytes(4, "big")
        for order in range(4):
            below[raw[3 - order : 3]][raw[3]] += n

    def p(context, byte):
        if context is None:
            return 1 / 256
        own, shorter = below[context], context[1:] if context else None
        if context and sum(own.values()) < max(2, share * total):
            return p(shorter, byte)
        n, d = sum(own.values()), len(own)
        if own[byte]:
            return own[byte] / (n + d)
        left = 1 - sum(p(shorter, b) for b in own if own[b])
        return d / (n + d) * p(shorter, byte) / left

    padded = b"\0\0\0" + text
    for i in range(len(text)):
        context = padded[i : i + 3]
        bits -= np.log2(p(context, padded[i + 3]))
    return bits


def test_ppm_nodes_are_distributions():
    rng = random.Random(1)
    grams = collections.Counter()
    for lang, alphabet in (("a", "abc "), ("b", "bcd ")):
        text = "".join(rng.choice(alphabet) for _ in range(3000)).encode()
        padded = b"\0\0\0" + text
        for i in range(len(text)):
            grams[lang, int.from_bytes(padded[i : i + 4], "big")] += 1
    model = ppm_lang.build_model(orders(grams, 1e-3))
    weights = np.ones(model.width)
    weights[0] = 256 - (model.width - 1)
    for cost in model.cost:
        assert np.allclose((np.exp2(-cost.reshape(-1, model.width).astype(float)) * weights).sum(1), 1, atol=1e-4)
    texts = pa.array(["abcabc", "dcbdcb"])
    data, offs = ppm_lang.column_bytes(texts)
    assert ppm_lang.code_lengths(model, data, offs)[0].argmin(1).tolist() == [0, 1]


def test_code_lengths_equal_the_plain_recursion():
    rng = random.Random(12)
    grams = collections.Counter()
    for lang, words in (("a", ["the", "cat", "sat", "mat"]), ("b", ["der", "hut", "rot", "caf\u00e9"])):
        raw = " ".join(rng.choice(words) for _ in range(120)).encode()
        padded = b"\0\0\0" + raw
        for i in range(len(raw)):
            grams[lang, int.from_bytes(padded[i : i + 4], "big")] += 1
    texts = ["the cat", "der hut rot", "xyz q caf\u00e9", "t", "sat sat mat the"]
    for share in (1e-9, 0.02):
        model = ppm_lang.build_model(orders(grams, share))
        data, offs = ppm_lang.column_bytes(pa.array(texts))
        got, _ = ppm_lang.code_lengths(model, data, offs)
        for k, lang in enumerate(("a", "b")):
            own = {g: n for (l, g), n in grams.items() if l == lang}
            seen = {g & 255 for _, g in grams}
            for t, text in enumerate(texts):
                if all(b in seen for b in text.encode()):
                    assert abs(got[t, k] - plain_bits(text.encode(), own, share)) < 1e-3


def test_letters_are_those_of_the_letter_categories():
    assert not any(map(ppm_lang.has_letter, ["\u00bd \u00b2 \u2460", "\u2167", "42 _", "", None]))
    assert all(map(ppm_lang.has_letter, ["\u00bd a", "\u00e9", "\u4e2d", "\u00aa"]))


def test_unlearned_languages_and_random_letters_are_rejected(spark):
    rng = random.Random(3)
    learned = {"en": "the quick brown fox jumps over the lazy dog and runs into the forest while other animals look at it".split(), "fr": "le renard brun saute par dessus le chien et court dans la foret pendant que les autres animaux le regardent".split()}
    rows = [(k, " ".join(rng.choice(learned[lang]) for _ in range(60)), lang) for k in range(200) for lang in ("en", "fr")]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)]
    odd = ["nopea ruskea kettu hyppii laiskan koiran yli", "xqzjv kwpfm zzxqt bvnmk qwrtp", "szybki lis przeskakuje nad leniwym psem", "42 !!"]
    odd_ids = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 5 == 0][:4]
    docs = spark.createDataFrame(rows + [(k, t, None) for k, t in zip(odd_ids, odd)], "doc_id long, text string, lang string")
    docs = docs.selectExpr("*", "lang as lang_pred", "1.5 as score", "0 as gain", "'t' as _text", "1 as bits_per_byte")
    left = ppm_lang.reject_unknown(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(range(400))


@docs_table
def test_language_accuracy_on_held_out(spark):
    docs = documents(spark)
    rows = ppm_lang.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def test_code_length_of_a_long_text_is_the_sum_of_its_pieces(monkeypatch):
    text = "the cat sat on the mat and " * 300
    padded = b"\0\0\0" + text.encode()
    grams = collections.Counter(int.from_bytes(padded[i : i + 4], "big") for i in range(len(text)))
    model = ppm_lang.build_model(orders({("en", g): n for g, n in grams.items()}))
    data, offs = ppm_lang.column_bytes(pa.array([text, "", text[:50]]))
    whole, plain = ppm_lang.code_lengths(model, data, offs)
    monkeypatch.setattr(ppm_lang, "PIECE", 1000)
    bits, again = ppm_lang.code_lengths(model, data, offs)
    assert np.allclose(whole, bits) and np.allclose(plain, again) and whole[1, 0] == plain[1] == 0


def test_ordinal_gradient_fit_orders_grades():
    rng = np.random.default_rng(3)
    rows, grades = [], []
    for _ in range(1500):
        grade = int(rng.integers(0, 3))
        noise = rng.integers(100, 2000, 30).astype(np.int32)
        marks = {0: [7], 1: [8], 2: [9]}[grade]
        rows.append(np.unique(np.concatenate((noise, np.array(marks, np.int32)))))
        grades.append(grade)
    model = ordinal.fit(np.array(grades), rows)
    assert (np.diff(model.thresholds) > 0).all() and model.weights[7] < model.weights[8] < model.weights[9]
    tails = [model.tails(float(model.weights[r].sum())) for r in rows]
    assert np.mean([(t >= 0.5).sum() == g for t, g in zip(tails, grades)]) > 0.95
    assert ordinal.fit(np.array([2, 2]), rows[:2]).weights.sum() == 0


@docs_table
def test_every_query_runs_without_the_oracle_disagreeing(spark):
    import duckdb

    db = duckdb.connect()
    for name in ("documents", "pages"):
        db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, SF)
        want = db.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), name


@pytest.mark.parametrize("intact, edited", [(0, 1), (0, 90), (3, 1), (100, 2), (2, 150)])
def test_evenly_edited_leaks_are_found_beside_intact_ones(spark, intact, edited):
    rng = random.Random(31)
    words = vocabulary(rng)
    item, short = [rng.choice(words) for _ in range(20)], [rng.choice(words) for _ in range(6)]
    sixth = [f"x{k}" if k % 6 == 5 else w for k, w in enumerate(item)]
    fourth = [f"y{k}" if k % 4 == 3 else w for k, w in enumerate(item)]
    kinds = [(item, 1)] * intact + [(sixth, 1), (fourth, 1)] * edited + [(short, 2)] * intact + [(["z", *short[1:]], 2), ([*short[:-1], "z"], 2)] * edited
    rows, want = [], set()
    for k, (copy, of) in enumerate(kinds):
        text = [rng.choice(words) for _ in range(60)]
        text[20:20] = copy
        rows.append((k, " ".join(text)))
        want.add((k, of))
    rows.append((len(rows), " ".join(rng.choice(words) for _ in range(60))))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()} == want


def test_secrets_beside_patterns_and_inside_paths_are_found():
    rng = random.Random(41)
    words = ["user", "account", "name", "index", "value", "update", "record", "parse", "find", "next", "config", "file", "path"]
    plain = [rng.choice("/_-").join(rng.choice(words) for _ in range(6)).encode() for _ in range(400)]
    model = secrets.train(secrets.seeded_random(), plain[:200])

    def spans(text):
        runs = [r for _, found in secrets._suspects(pa.array([text]), secrets.MIN_RUN) for r in found]
        return secrets.all_spans(text, runs, model, secrets.BITS_PER_CHAR)[1]

    for _ in range(50):
        token = "".join(rng.choice(secrets.KEY_CHARS[:62]) for _ in range(40))
        path = "/".join(rng.choice(words) for _ in range(12))
        key, hexa = "AKIA" + "".join(rng.choice("ABCDEFG0123456789") for _ in range(16)), "".join(rng.choice("0123456789abcdef") for _ in range(24))
        for text in (f"{key}/{token}", f"é {hexa}-{token}", f"/{path}/{token[:32]}", f"{token}/{key}", f"/{path}/{token}/{path}"):
            at = text.index(token[:32])
            assert any(s <= at and at + 32 <= e for s, e, k in spans(text) if k == "markov"), text
        whole = [(s, e) for s, e, k in spans(f"/{path}/{token[:32]}") if k == "markov"]
        assert whole[0][0] >= len(path) - 15
    assert not [t for t in plain[200:] if spans(t.decode())]


def test_small_sources_meet_their_targets_over_many_shards(spark):
    sizes = {"big": 64 * 900, "cap": 64 * 20, "one": 64, "few": 10, "odd": 65}
    rows = [(k, source, " ".join(["w"] * n)) for k, (source, n) in enumerate(sizes.items())]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for seed in (1, 2, 3):
        plan = mixing.mix_plan(docs, weights=(1.0,), shard=8, seed=seed)
        got = {r["doc_id"]: r for r in mixing.document_shares(plan).collect()}
        for k, source, _ in rows:
            if source != "big":
                assert got[k]["taken"] == got[k]["target"] == 2 * sizes[source]
        assert abs(got[0]["taken"] - got[0]["target"]) < 64
        taken = collections.Counter((r["idx"], r["block"]) for r in plan.slots.collect())
        assert max(taken.values()) <= 2


def test_slot_totals_follow_targets_in_the_mean():
    sizes = np.array([1, 10, 64, 65, 100, 130, 700, 6400, 0])
    for part in (0.03, 0.4, 0.7, 0.97, 1.3, 2.0):
        got = []
        for seed in range(3000):
            epochs, wholes, last = mixing.slot_totals(sizes, part * sizes, 2, 64, seed)
            end = sizes - np.maximum(-(-sizes // 64) - 1, 0) * 64
            got.append(epochs * sizes + wholes * 64 + last * end)
            assert (abs(got[-1] - part * sizes) < 128).all() and (got[-1] <= 2 * sizes).all()
        assert (abs(np.mean(got, 0) - part * sizes) <= 3 + 0.01 * sizes).all()


def test_markov_spans_of_a_scan_find_planted_keys(spark):
    """Recall and false hits of the models through scan: keys that no pattern matches, in several alphabets."""
    rng = random.Random(44)
    words = vocabulary(rng, 500)
    alphabets = {"base62": secrets.KEY_CHARS[:62], "base64": secrets.KEY_CHARS[:64], "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}
    plain = [rng.choice("/_-").join(rng.choice(words) for _ in range(rng.randint(4, 9))) for _ in range(300)]
    rows, planted = [], {}
    for k in range(600):
        text = " ".join(rng.choice(words) for _ in range(30)) + f" {rng.choice(plain)} "
        if k % 2:
            kind = sorted(alphabets)[k % 3]
            planted[k] = (kind, len(text), "".join(rng.choice(alphabets[kind]) for _ in range(rng.randint(28, 48))))
            text += planted[k][2] + " end"
        rows.append((k, text))
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = collections.Counter()
    for k, (kind, at, key) in planted.items():
        spans = [x.split(":") for x in got[k]["spans"].split(",") if x.startswith("markov")]
        hit[kind] += any(int(s) <= at and at + len(key) <= int(e) for _, s, e in spans)
    assert all(hit[kind] >= 0.95 * sum(p[0] == kind for p in planted.values()) for kind in alphabets), hit
    assert sum(r["n_markov"] > 0 for k, r in got.items() if k not in planted) <= 3


def test_shard_counts_are_a_draw_that_adds_up():
    totals, shards = np.array([1, 40, 700, 3000, 0]), 13
    starts = np.array([0.2, 0.5, 0.9, 0.1, 0.3])
    for group in (4, 13, 100):
        every = list(mixing.shard_counts(totals, starts, shards, group, 9, 0, shards))
        counts = np.array([c for _, _, c in every])
        assert [k for k, _, _ in every] == list(range(shards)) and (counts.sum(0) == totals).all()
        assert (np.cumsum(counts, 0) - counts == np.array([b for _, b, _ in every])).all()
        part = list(mixing.shard_counts(totals, starts, shards, group, 9, 5, 8))
        assert all(k == every[k][0] and (c == every[k][2]).all() and (b == every[k][1]).all() for k, b, c in part)
    sizes = counts.sum(1)
    assert sizes.max() - sizes.min() <= 1
    draws = np.array([[c[2] for _, _, c in mixing.shard_counts(totals, starts, shards, 100, seed, 0, 1)][0] for seed in range(800)])
    share = sizes[0] / totals.sum()
    spread = 700 * share * (1 - 700 / totals.sum()) * (1 - share) * totals.sum() / (totals.sum() - 1)
    assert abs(draws.mean() - 700 * share) < 1 and 0.8 < draws.var() / spread < 1.25


@docs_table
def test_taken_words_are_those_of_the_slots(spark):
    docs = documents(spark)
    plan = mixing.mix_plan(docs)
    times = collections.Counter((r["idx"], r["block"]) for r in plan.slots.collect())
    where = {r["_row"]: r for r in plan.documents.collect()}
    want = collections.Counter()
    for r in where.values():
        for word in range(r["offset"], r["offset"] + r["size"]):
            want[r["doc_id"]] += times[r["idx"], word // mixing.BLOCK]
    assert all(r["taken"] == want[r["doc_id"]] for r in mixing.document_shares(plan).collect())


@docs_table
def test_held_out_ratings_are_kept_apart(spark):
    folder = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = ordinal.select_quality(docs, labels).where("held_out").join(ordinal.graded(labels), "doc_id").collect()
    kept = {g: np.mean([r["kept"] for r in out if r["grade"] == g]) for g in (0, 1, 2)}
    print("kept of toxic, poor, good:", kept)
    assert kept[2] >= 0.97 and kept[1] <= 0.12 and kept[0] <= 0.05, kept


def test_one_row_of_each_group_is_left(spark):
    rng = random.Random(21)
    words = vocabulary(rng)
    base = [rng.choice(words) for _ in range(60)]
    near = [*base[:-1], "other"]
    far = " ".join(rng.choice(words) for _ in range(60))
    rows = [(1, " ".join(base), "a"), (1, " ".join(near), "b"), (2, " ".join(near), "a"), (2, far, "c"), (3, far, "z"), (3, far, "b"), (4, None, "n"), (4, None, "n"), (None, far, "q"), (None, far, "q"), (5, " ", "w"), (6, " ", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string").selectExpr("*", "1 as kept", "2 as _id", "3 as text_hash")
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["_text"]) for r in left.collect()), key=repr)
    one = [r for r in got if r[0] == 1]
    assert len(one) == 1 and [r for r in got if r[0] != 1] == sorted([(2, far, "c"), (None, far, "q"), (None, far, "q"), (4, None, "n"), (5, " ", "w"), (6, " ", "w")], key=repr)


def plain_fingerprint(spark, text):
    """The fingerprint by votes in plain Python; the hash of a pair is Spark's."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    pairs = list(zip(words, words[1:])) or [(words[0], None)]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    hashes = {r["k"]: r["h"] & (2**64 - 1) for r in frame.select("k", F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64("a", "b")).alias("h")).collect()}
    weights = [min(len(a) + len(b), simhash.MAX_WEIGHT) if b else 1 for a, b in pairs]
    return sum(1 << bit for bit in range(64) if sum(w if hashes[k] >> bit & 1 else -w for k, w in enumerate(weights)) > 0)


def test_fingerprints_equal_plain_votes(spark):
    rng = random.Random(19)
    texts = [" ".join(rng.choice(["a", "b\u00e9", "ccc", "longerword", "\u4e2d"]) for _ in range(rng.randint(0, 40))) for _ in range(12)] + ["one", ""]
    got = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in got} == {k: plain_fingerprint(spark, t) for k, t in enumerate(texts)}


def test_next_documents_of_odd_ids(spark):
    rng = random.Random(23)
    ids = [-(10**15), 5, 5, 5, None, None, 10**17, *range(100, 140)]
    rows = [(k, " ".join(rng.choice(["one", "two", "three"]) + str(rng.randrange(99)) for _ in range(12))) for k in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(keyed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), -r["h"]))
    want = []
    for r, follow in zip(order, order[1:] + order[:1]):
        cut = len(r["text"]) // 2
        want.append((r["doc_id"], hashlib.sha256((r["text"][: len(r["text"]) - cut] + follow["text"][:cut]).encode()).hexdigest()))
    for rows_a_bucket in (2000, 3):
        simhash.ROWS_A_BUCKET = rows_a_bucket
        got = [(r["doc_id"], r["edited_sha256"]) for r in simhash.compare_edited(docs).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    simhash.ROWS_A_BUCKET = 2000


def test_large_buckets_and_large_classes_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3)
    fps = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (60, 2))}
    near = simhash.near_counts(spark.createDataFrame([(x,) for x in fps], "fp long"), 3)
    got = {r["fp"]: r["n_near"] for r in near.collect()}
    assert got == {x: sum(1 for y in fps if x != y and (x ^ y).bit_count() <= 3) for x in fps}

    texts = {1: "one two three four", 2: "five six seven eight nine", 3: "ten eleven twelve"}
    docs = [(k, texts[1 + (k % 10 > 6) + (k % 10 > 8)]) for k in range(60)] + [(None, texts[1]), (None, None)]
    monkeypatch.setattr(simhash, "HOT", 2)
    rows = simhash.compare_edited(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    text_of = dict(docs[:60])
    for r in rows:
        if r["doc_id"] is not None:
            assert r["class_id"] == min(k for k, t in text_of.items() if t == text_of[r["doc_id"]])
    alone = [r for r in rows if r["doc_id"] is None]
    assert sorted((r["class_id"] is None, r["n_chars"]) for r in alone) == [(False, len(texts[1])), (True, 0)]
