"""Edge cases that every corpus operator must take: nulls, empty and long texts, ties, repeated rows,
empty tables, and extra columns whose names clash with inner ones."""

from __future__ import annotations

import pytest

from timeweave.llm import cdc, decontam, minhash, mixing, ordinal, ppm_lang, secrets, simhash, token_rollup, warc
from timeweave.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, size string, b string, component string"
LONG = "word " * 60_000 + "x" * 70_000
ROWS = [
    (1, "the cat sat on the mat and looked at the dog by the door", "en", "a"),
    (1, "the cat sat on the mat and looked at the dog by the door", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (None, "le chat est sur la table et regarde le chien", "fr", "b"),
    (5, LONG, "en", None),
    (6, " \t\n", "fr", "c"),
    (7, "token = 'abcdef0123456789abcdef01' é", "en", "c"),
    (8, "42", None, "c"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, len(r[1] or ""), "n", "k", "s", "b", "c") for r in rows], DOCS)


BENCH = "item_id long, text string, h string"


def run(spark, docs, name):
    if name == "decontam":
        return decontam.leaks(docs, spark.createDataFrame([(1, "looked at the dog by the door", "x"), (2, None, "x"), (3, " ", "x")], BENCH))
    if name == "rollup":
        rollup = token_rollup.Rollup(spark, shared_dir(spark, "rollup"))
        token_rollup.corpus_history(docs, rollup)
        return rollup.totals()
    if name == "warc":
        path = shared_dir(spark, "warc")
        warc.write_archives(docs.selectExpr("doc_id as page_id", "text as html", "key", "size"), path)
        return warc.records(warc.read_chunks(spark, path))
    if name == "ordinal":
        return ordinal.select_quality(docs, spark.createDataFrame([(1, 1, 0), (7, 0, 1), (3, None, 0), (9, 1, 0)], "doc_id long, quality int, toxic int"))
    return {
        "cdc": cdc.repeats,
        "cut": cdc.remove_repeats,
        "secrets": secrets.scan,
        "redact": secrets.redact,
        "simhash": simhash.compare_edited,
        "minhash": minhash.near_duplicates,
        "mix": lambda d: mixing.document_shares(mixing.mix_plan(d)),
        "blocks": lambda d: mixing.mixed_blocks(mixing.mix_plan(d), d),
        "ppm": ppm_lang.identify,
        "reject": ppm_lang.reject_unknown,
    }[name](docs)


NAMES = ["decontam", "rollup", "warc", "ordinal", "cdc", "cut", "secrets", "redact", "simhash", "minhash", "mix", "blocks", "ppm", "reject"]
EVERY_ROW = {"warc", "ordinal", "cut", "secrets", "redact", "simhash", "minhash", "mix", "ppm"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    got = run(spark, frame(spark), name).collect()
    if name in EVERY_ROW:
        assert len(got) == len(ROWS)
    if name == "decontam":
        assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 1), (1, 1)]
    if name == "minhash":
        by = {r["doc_id"]: r for r in got}
        assert by[2]["n_shingles"] == 0 and by[2]["kept"] and by[3]["component_id"] == 3
        assert by[None]["component_id"] is None and not by[None]["kept"]
        assert [r["kept"] for r in got if r["doc_id"] == 1] == [True, True]
    if name == "ppm":
        by = {r["doc_id"]: r for r in got}
        assert by[2]["lang_pred"] == by[3]["lang_pred"] == by[8]["lang_pred"] == "und" and by[2]["score"] == 0
    if name == "reject":
        ids = [r["doc_id"] for r in got]
        assert ids.count(1) == 2 and 5 in ids and not {2, 3, 6, 8} & set(ids)
    if name == "secrets":
        by = {r["doc_id"]: r for r in got}
        assert by[7]["n_assign"] == 1 and by[7]["n_hex"] == 1 and by[7]["spans"] == "assign:0:33,hex:9:33"
    if name == "redact":
        assert [r["text"] for r in got if r["doc_id"] == 7] == ["[SECRET]' é"]
    if name == "mix":
        by = {r["doc_id"]: r for r in got}
        assert by[2]["size"] == by[2]["taken"] == 0 and by[5]["size"] == 60_001
        assert all(r["taken"] <= 2 * r["size"] for r in got)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert run(spark, frame(spark, []), name).count() == 0
