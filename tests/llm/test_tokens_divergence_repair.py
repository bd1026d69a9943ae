"""Token pages, source divergence and conversation repair against brute force, round trips and odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from timeweave.llm import conversations as cv
from timeweave.llm import divergence as dv
from timeweave.llm import queries
from timeweave.llm import token_pages as tp
from timeweave.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


# ---------------------------------------------------------------------------------------- token pages


@pytest.mark.parametrize("most", [4, 6, 20])
def test_code_lengths_are_optimal(most):
    """Against all length-limited codes of few ids; Kraft's sum is met exactly."""
    rng = random.Random(most)
    for _ in range(20):
        counts = np.array([rng.choice([0, 1, 2, 5, 30, 400]) for _ in range(7)])
        lengths = tp.code_lengths(counts, most)
        used = counts[counts > 0]
        assert ((lengths > 0) == (counts > 0)).all()
        if len(used) < 2:
            continue
        assert sum(2.0 ** -int(n) for n in lengths if n) == 1 and lengths.max() <= most
        best = min(
            sum(a * b for a, b in zip(sorted(used.tolist(), reverse=True), ls))
            for ls in itertools.combinations_with_replacement(range(1, min(most, 7) + 1), len(used))
            if sum(2.0**-n for n in ls) <= 1
        )
        assert int((lengths * counts).sum()) == best


def test_more_ids_than_codes_is_an_error():
    with pytest.raises(ValueError):
        tp.code_lengths(np.ones(5, np.int64), 2)


@pytest.mark.parametrize("n_ids", [1, 2, 300, 5000])
def test_pages_round_trip(n_ids, monkeypatch):
    monkeypatch.setattr(tp, "PAGE", 4096)
    monkeypatch.setattr(tp, "ROOM", 8 * (4096 - 1 - tp.HEADER.size - 16))
    rng = np.random.default_rng(n_ids)
    counts = rng.integers(1, 900, 60)
    ids = np.minimum(rng.geometric(0.05, counts.sum()) - 1, n_ids - 1).astype(np.uint32)
    code = tp.Code(tp.code_lengths(np.bincount(ids)))
    names = np.ma.array(np.arange(60), mask=np.arange(60) == 0)
    cut = np.cumsum(counts)
    parts = [(ids[a:b], names[i:j], counts[i:j]) for i, j in ((0, 7), (7, 8), (8, 60)) for a, b in [(cut[i - 1] if i else 0, cut[j - 1])]]
    pages = list(tp.pages_of(iter(parts), code, 5))
    assert all(len(p) == 4096 and p[-1:] == b"\n" for p in pages)
    table = code.table()
    for lots in (pages, pages[::-1]):  # pages stand alone
        whole = collections.defaultdict(list)
        for k in range(0, len(lots), 3):
            for piece in tp.read_pieces(lots[k : k + 3], code, table):
                whole[piece.doc_id, piece.start, piece.n].append((piece.at, piece.ids.tolist()))
        got = {k: [x for _, part in sorted(v) for x in part] for k, v in whole.items()}
        want = {(None if i == 0 else i, int(cut[i] - counts[i]), int(counts[i])): ids[cut[i] - counts[i] : cut[i]].tolist() for i in range(60)}
        assert got == want
    damaged = bytearray(pages[0])
    damaged[2000] ^= 1
    with pytest.raises(ValueError):
        list(tp.read_pieces([bytes(damaged)], code, table))


def test_crc_of_pieces():
    data = bytes(range(256)) * 9
    assert tp.crc_before(zlib.crc32(data[:700]), len(data) - 700) ^ zlib.crc32(data[700:]) == zlib.crc32(data)


ODD_TEXTS = [
    "", None, " ", "a  b", " a b", "a b ", "don't we're  'ello\n\nx y", "ä ß × ÷ 12 3a b4", "x y z w", "<|endoftext|> a <|endoftext|>b",
    "emoji 😀 a", "日本 語 a b", "it 's 've ' s", "a ́b c", "²³ ½ x1² y", "a\x1cb c \x1d d", "tab\t x\t\ty z", "A" * 3000 + " b",
]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    whole, long = tokenizer(), "ab cd. ef\n" * 30_000
    monkeypatch.setattr(tp, "KNOWN_PIECES", 40)  # forgets all the time
    encoder = tp.Encoder(open(VOCABULARY, encoding="utf-8").read(), 2)
    rng = random.Random(1)
    texts = [*ODD_TEXTS, long, "a  " + long] + ["".join(rng.choice("ab .,'\n\tÄ1") for _ in range(40)) for _ in range(300)]
    for at in range(0, len(texts), 17):
        lot = texts[at : at + 17]
        ids, counts = encoder.encode(pa.array(lot, pa.string()))
        want = [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in lot]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
        assert encoder.count(pa.array(lot, pa.string()))[: ids.max() + 1].tolist() == np.bincount(ids).tolist()


def expected_digests(rows):
    whole, at, out = tokenizer(), 0, []
    for doc_id, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@given
def test_op11_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.op11_token_pages(spark, SF).orderBy("doc_id").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert list(map(tuple, got)) == expected_digests(map(tuple, docs))


def test_token_files_take_odd_rows(spark):
    rows = [(None, "x y"), (1, None), (2, ""), (3, "word " * 40_000 + "x" * 5000), (4, "same text"), (4, "same text"), (5, "é a")]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, start long, ids string")
    path = shared_dir(spark, "tokens")
    tp.write(frame, path, VOCABULARY, 2)
    got = tp.read_digests(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected_digests(rows)
    whole = collections.defaultdict(list)
    for r in tp.read_ids(spark, path).collect():
        whole[r["file"], r["start"]].append((r["at"], r["ids"]))
    assert all(sum(len(p) for _, p in v) in {r["n_tokens"] for r in got} for v in whole.values())
    order = spark.read.text(f"{path}/pages").count()
    assert order > 0
    empty = shared_dir(spark, "tokens")
    tp.write(frame.limit(0), empty, VOCABULARY, 2)
    assert tp.read_digests(spark, empty).count() == 0


def test_texts_are_read_and_encoded_once(spark):
    rows = [(i, f"text {i} of the sun, the moon.\nAnd so on") for i in range(20)]
    made = spark.sparkContext.accumulator(0)

    def same(x):
        made.add(1)
        return x

    text = F.udf(same, "string").asNondeterministic()("text")
    path = shared_dir(spark, "tokens")
    tp.write(spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", text), path, VOCABULARY, 2)
    assert made.value == len(rows)
    assert [tuple(r) for r in tp.read_digests(spark, path).orderBy("start").collect()] == expected_digests(rows)


def test_long_rows_of_one_document_stay_apart(spark):
    rows = [(7, "ab cd. " * 50_000)] * 3 + [(8, None), (9, "x")]  # more ids than a row takes between the passes
    path = shared_dir(spark, "tokens")
    tp.write(spark.createDataFrame(rows, "doc_id long, text string"), path, VOCABULARY, 2)
    assert [tuple(r) for r in tp.read_digests(spark, path).orderBy("start").collect()] == expected_digests(rows)


def test_the_library_gets_few_texts_and_each_piece_once():
    encoder = tp.Encoder(open(VOCABULARY, encoding="utf-8").read(), 2)
    own, given_texts = encoder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            given_texts.extend(texts)
            return own.encode_batch_fast(texts, **more)

    encoder.tokenizer = Counting()
    words = ["".join(x) for x in itertools.product("abcdefgh", repeat=3)]
    text = " ".join(["x", *words, *(w + "," for w in words), *(w + ".\nThe" for w in words)])
    ids, _ = encoder.encode(pa.array([text]))
    assert ids.tolist() == [*own.encode(text, add_special_tokens=False).ids, 2]
    assert len(given_texts) < 10 and sum(map(len, given_texts)) < 4 * len(words) + 20


def test_finer_cuts_give_the_ids_of_whole_texts():
    """Letters, marks that end clauses, line feeds and blanks in any order, with and without a token that a cut would split."""
    import json

    rng = random.Random(3)
    texts = ["".join(rng.choice("abÄ×,.;:!?'-1\n\n \t") for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["a  <|endoftext|>. b", "a <|endoftext|>.\nB c", "a Ġb Ġ, c.Ġ d", "x e\u0301. y", "x a\u00a0.\nB y", "x .\r\nB y a.\n\nB z"]
    spec = json.loads(open(VOCABULARY, encoding="utf-8").read())
    other = dict(spec, added_tokens=[*spec["added_tokens"], dict(spec["added_tokens"][0], id=50257, content="a.b")])
    from tokenizers import Tokenizer

    for source in (json.dumps(spec), json.dumps(other)):
        whole, encoder = Tokenizer.from_str(source), tp.Encoder(source, 2)
        for at in range(0, len(texts), 500):
            lot = texts[at : at + 500]
            want = [i for t in lot for i in [*whole.encode(t, add_special_tokens=False).ids, 2]]
            assert encoder.encode(pa.array(lot))[0].tolist() == want


# ----------------------------------------------------------------------------------------- divergence


def audit_by_hand(rows, least, top):
    term = re.compile(dv.TERM)
    lower = str.maketrans(dv.UPPER, dv.LOWER)
    docs = [(lang or "", source or "", term.findall((text or "").translate(lower))) for text, lang, source in rows]
    in_docs, groups = collections.Counter(), {}
    for lang, source, terms in docs:
        in_docs.update((lang, t) for t in set(terms))
        groups.setdefault((lang, source), collections.Counter()).update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in in_docs.items() if x == lang and n >= least)
        own = {s: c for (x, s), c in groups.items() if x == lang}

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(pairs)]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms)]
    return sorted(out)


def audited(spark, rows, **limits):
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "text string, lang string, source string, shard int, slots string, n string")
    return sorted(map(tuple, dv.audit(frame, **limits).collect()))


@pytest.mark.parametrize("limit", [dv.BROADCAST_BYTES, 300])  # one round, many rounds
def test_divergence_equals_plain_python(spark, monkeypatch, limit):
    monkeypatch.setattr(dv, "SHARD_TERMS", 5)
    monkeypatch.setattr(dv, "SOURCES_A_TILE", 2)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé日") for _ in range(rng.randint(1, 14))) for _ in range(60)] + ["Straße", "ÄÖ", "x" * 40, "x" * 41]
    rows = [(rng.choice([" ", "-", "1\n"]).join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice("abcde")) for _ in range(150)]
    rows += [(None, "en", "a"), ("", "fr", None), ("UPPER upper Upper", "fr", "z"), ("lonely", "xx", "only")] + [rows[0]] * 4
    assert audited(spark, rows, broadcast_bytes=limit, top=7) == audit_by_hand(rows, 3, 7)


def test_divergence_of_odd_tables(spark):
    assert audited(spark, []) == []
    long = ("word " * 300_000) + "y" * 1_200_000 + " tail"  # more than one window, one run longer than any
    rows = [(long, "en", "a"), (long, "en", "b"), (long, "en", "b")]
    assert audited(spark, rows) == audit_by_hand(rows, 3, 200)


def test_perfect_hashes_fill_all_slots():
    terms = [f"t{i}" for i in range(4000)]
    h = dv.term_hashes(terms)
    d = dv.displace(h, dv.n_buckets(len(terms)))
    slots = dv.slot_of(h, d[((h & np.uint64(0xFFFFFFFF)) % np.uint64(len(d))).astype(np.int64)], len(terms))
    assert sorted(slots.tolist()) == list(range(4000))


def test_shares_are_exact_for_large_counts():
    counts, total = np.array([0, 7, 10**15, 8 * 10**15 - 1]), 9 * 10**15
    assert dv.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


# --------------------------------------------------------------------------------------------- repair


def cheapest(codes):
    """Least cost and audit over all edits, with up to two insertions before each row and at the end."""
    best = [(1 << 40, "")]

    def go(pos, s, cost, audit):
        if cost > best[0][0]:
            return
        for _ in range(3):
            if pos == len(codes):
                if s in (cv.NOTHING, cv.ASSISTANT):
                    best[0] = min(best[0], (cost, audit))
            else:
                initial, fault = codes[pos]
                go(pos + 1, s, cost + 3, audit + "D")
                if fault not in (1, 2):
                    more = int(fault == 3)
                    go(pos + 1, cv.NEXT[s], cost + 2 + more, audit + "R")
                    if initial and (initial == cv.NEXT[s] or (initial == cv.SYSTEM and s == cv.NOTHING)):
                        go(pos + 1, initial, cost + more, audit + "K")
            s, cost, audit = cv.NEXT[s], cost + 2, audit + "I"

    go(0, cv.NOTHING, 0, "")
    return best[0]


@pytest.mark.parametrize("n", range(8))
def test_paths_equal_all_edits(n):
    rng = random.Random(n)
    for _ in range(60):
        codes = [(rng.randint(0, 3), rng.choice([0, 0, 1, 2, 3])) for _ in range(n)]
        items = [cv.step(*c) for c in codes]
        last, cost = cv.last_state(items)
        audit = cv.edits(items, cv.NOTHING, last) + "I" * cv.TAIL[last]
        assert (cost, audit) == cheapest(codes)
        for size in (1, 2, 3):  # the same in blocks
            blocks = [items[i : i + size] for i in range(0, n, size)]
            tables = [cv.summary(b) for b in blocks]
            end, whole = cv.last_state(tables)
            path = cv.crossings(tables, cv.NOTHING, end)
            assert (whole, "".join(cv.edits(b, path[i], path[i + 1]) for i, b in enumerate(blocks)) + "I" * cv.TAIL[end]) == (cost, audit)


CONVERSATION = "conv_id long, turn long, role string, text string, block long, codes string"


@pytest.mark.parametrize("block_rows", [2, 4096])
def test_repair_of_odd_conversations(spark, monkeypatch, block_rows):
    monkeypatch.setattr(cv, "BLOCK_ROWS", block_rows)
    rows = [
        (1, 0, "user", "Hi there."), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "Yes!"), (1, 4, "user", "cut off"), (1, 5, "tool", "?"),
        (2, None, "system", "Be."), (2, 3, "assistant", "So."), (2, 7, "user", " \t"), (3, None, "", ""), (None, 1, "user", "A?"), (None, 2, "assistant", "x" * 90_000),
    ]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATION).repartition(4)
    got = {r["conv_id"]: r for r in cv.repair(frame).collect()}
    digest = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert tuple(got[1])[1:8] == (2, 0, 1, 1, 2, 6, "KKDKR") and got[1]["repaired_sha256"] == digest("user:Hi there.", "assistant:Yes!", "user:cut off", "assistant:?")
    assert tuple(got[2])[1:8] == (3, 1, 0, 0, 1, 5, "KIKD") and got[2]["repaired_sha256"] == digest("system:Be.", "user:", "assistant:So.")
    assert tuple(got[3])[1:8] == (0, 1, 0, 0, 0, 3, "D") and got[3]["repaired_sha256"] == digest("")
    assert tuple(got[None])[1:8] == (0, 0, 0, 1, 0, 1, "KK")
    gone = cv.repair(frame.withColumn("dropped", F.lit(True))).collect()
    assert len(gone) == 4 and {tuple(r)[1:] for r in gone} == {(0, 0, 0, 0, 0, 0, "", digest(""))}
    assert cv.repair(frame.limit(0)).count() == 0


def test_damage_follows_the_hash(spark):
    rows = [(i, j, "assistant", "A. b!") for i in range(12) for j in range(9)] + [(None, None, None, None)]
    got = collections.Counter(map(tuple, cv.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = collections.Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        want[c, t, "user" if kind == 4 else role, text, kind == 0] += 2 if kind == 3 else 1
    assert got == want


@given
@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_conversation_repair"])
def test_query_equals_its_twin(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = db.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
