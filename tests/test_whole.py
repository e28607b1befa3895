"""Queries over small tables with rows and texts of all kinds, by brute force."""

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.plans import registry
from demandlens.plans.bindings import Tables

SF = "/root/testdata/sf0.001"
FILL = "lorem ipsum dolor sit amet " * 30
TEXTS = {
    1: FILL + "and the house of the king in the und der die la",
    2: FILL, 3: "la la " + FILL + "de la que", 4: "", 5: None, 6: "of the " * 300, 7: "Größe der Straße und der Weg die Übung",
    8: "in the of the and the", 9: "  blanks \t around\n\n\n\nand  within \n", 10: "naïve café: the “quoted” text, 12 words of it and more", 11: " x" + FILL + "é",
}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("whole")
    spark.createDataFrame([(i, t, "en") for i, t in TEXTS.items()], "doc_id long, text string, lang string").write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{SF}/part.parquet").write.parquet(f"{root}/part.parquet")
    return lambda name: registry.queries()[name](spark, str(root))


def hits(text):
    w = (text or "").lower().split()
    known = {a: i for i, a in enumerate(["the", "of", "and the", "of the", "in", "die", "und", "der die", "de la", "que", "la"])}
    masked = {j for i in range(len(w) - 1) if " ".join(w[i : i + 2]) in ("in the", "und der") for j in (i, i + 1)}
    out, i = [], 0
    while i < len(w):
        n = next((n for n in (2, 1) if i + n <= len(w) and " ".join(w[i : i + n]) in known and not masked & set(range(i, i + n))), 0)
        if n:
            out.append((i, i + n, known[" ".join(w[i : i + n])]))
        i += n or 1
    return out


def test_vocabulary_of_whole_texts(run):
    plain = [1, 2, 3, 4, 5, 6, 7, 8]  # texts whose tokens white space gives
    found = {r.span_id: r.hits for r in run("k3_vocabulary_hits").collect()}
    assert {i: found.get(i) for i in plain} == {i: ",".join(f"{a}:{b}:{s}" for a, b, s in hits(TEXTS[i])) or None for i in plain}
    first = {r.span_id: r.skill_id for r in run("j2_resolver").collect()}
    assert set(first) == set(TEXTS) and {i: first[i] for i in plain} == {i: (hits(TEXTS[i]) or [(0, 0, None)])[0][2] for i in plain}


def test_names_of_all_parts_are_aliases(spark, run, tmp_path):
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    name = part.where("p_partkey = 1500").select(F.concat_ws(" ", "p_name", "p_partkey")).first()[0]
    spark.createDataFrame([(1, FILL + name)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    part.write.parquet(f"{tmp_path}/part.parquet")
    assert [r.skill_id for r in registry.queries()["j2_resolver"](spark, str(tmp_path)).collect()] == [1500]


def test_taxonomy_form_of_whole_texts(run):
    out = {r.doc_id: r.norm for r in run("h8_taxonomy_normalize").collect()}
    assert set(out) == set(TEXTS) and out[3] == TEXTS[3] and out[7] == TEXTS[7].lower() and out[10] == "naïve café the quoted text 12 words of it and more" and out[11] == "x" + FILL + "é"


def test_tables_are_whole(spark):
    t = Tables(spark, SF)
    for own, name in ((t.matches, "orders"), (t.shortlist, "orders"), (t.citation, "lineitem"), (t.chunk, "embeddings")):
        assert own.count() == t.read(name).count(), name
    big = Tables(spark, "/root/testdata/sf0.01")
    assert big.skill.count() == big.read("part").count() == big.skill_alias.count() // 2 > 229 and big.requirement.where("skill_id >= 229").count() > 0


def test_nearest_of_all_vectors(spark):
    """Ids divisible by 20 against all rows that aren't deleted: also those divisible by 5, which the SQL leaves out."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    far = np.round(1 - (v @ v.T) / np.outer(*[np.linalg.norm(v, axis=1)] * 2), 9)
    live = [j for j in np.argsort(ids) if ids[j] % 11]
    best = {int(ids[i]): int(ids[min(live, key=lambda j: (far[i, j], ids[j]))]) for i in range(len(ids)) if ids[i] % 20 == 0}
    found = {r.query_id: r.chunk_id for r in registry.queries()["c9_nearest_chunk"](spark, SF).collect()}
    assert found == best and any(c % 5 == 0 for c in best.values())


def test_all_postings_are_scored(spark):
    found = registry.queries()["d14_coarse_score"](spark, "/root/testdata/sf0.01")
    assert found.count() == Tables(spark, "/root/testdata/sf0.01").posting.count() and found.where("posting_id >= 2000").count() > 0


def test_scalar_forms_of_all_documents(run):
    plain = lambda x: re.sub("[^0-9a-z]+", " ", "".join(c for c in unicodedata.normalize("NFKD", x or "") if not unicodedata.combining(c)).lower()).strip()
    ids = [i for i in TEXTS if i != 7]  # a sharp s has no decomposition
    out = {r.doc_id: r.norm for r in run("h1_identity_normalize").collect()}
    assert set(out) == set(TEXTS) and [out[i] for i in ids] == [plain(TEXTS[i]) for i in ids]
    out = {r.doc_id: r.collapsed for r in run("h10_text_collapse").collect()}
    assert set(out) == set(TEXTS) and out[9] == "blanks around\n\nand within" and out[4] == ""


def test_text_jobs_of_all_documents(run):
    out = {r.id: r.square for r in run("k2_hashed_embedding").collect()}
    assert set(out) == set(TEXTS) and all(abs(out[i] - bool(t)) < 1e-9 for i, t in TEXTS.items())
    chunks = {r.source_ref for r in run("k1_short_documents").collect()}
    assert chunks == {str(i) for i, t in TEXTS.items() if t}
    found = {(r.doc_id, r.n): r.found for r in run("k4_verbatim_found").collect()}
    assert {i for i, _ in found} == set(TEXTS)
    assert all(found[i, 0] and found[i, 1] and not found[i, 2] for i in (1, 2, 3, 6, 11))
    counts = {r.posting_id: (r.attempt, r.found, r.rejected) for r in run("k12_requirement_extraction").collect()}
    assert set(counts) == set(TEXTS) and counts[6][0] == 2 and counts[7] == (1, 2, 0) and counts[3] == (1, 1, 1) and counts[11] == (1, 2, 0)


def test_upsert_tells_updates(spark):
    key, rows = ("posting_id", "raw_text"), Tables(spark, SF).requirement.collect()
    rank = {"mentioned": 1, "preferred": 2, "required": 3}
    sides = [{}, {}]
    for r in rows:
        side, k = sides[r.quantity > 20], tuple(r[c] for c in key)
        side[k] = max(side.get(k, "mentioned"), r.importance, key=rank.get)
    old, new = sides
    expected = {k: (new.get(k, old.get(k)), "kept" if k not in new else "updated" if k in old else "inserted") for k in old | new}
    found = {(r.posting_id, r.raw_text): (r.importance, r.change) for r in registry.queries()["k10_requirement_upsert"](spark, SF).collect()}
    assert found == expected and {c for _, c in found.values()} == {"kept", "updated", "inserted"}
