import gzip
import os

import pytest
from pyspark.sql import functions as F

from pairrank.plans.ingest import Ingestion
from pairrank.sources.catalog import Source, catalogue, get_registered_source, register_source
from pairrank.sources.raw_files import hash_files, list_files
from pairrank.sources.readers import read, read_csv, read_fasta, read_sdf
from pairrank.sources.tables import KeyedTable
from pairrank.streaming.incremental import ingest_stream

MOLECULE = """{name}
  prog

  0  0  0  0  0  0            999 V2000
M  END
> <SMILES>
{smiles}

> <chembl_id>
{key}

> <note>
two
lines

$$$$
"""
ASPIRIN = MOLECULE.format(name="ASPIRIN", smiles="CC(=O)Oc1ccccc1C(=O)O", key="CHEMBL113")
INSULIN = ">P12345 Test Protein > odd\nMKWVTFISLLFL\nFSSAYSRGVFRR\n"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".gz":
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


@pytest.mark.parametrize("suffix", ["sdf", "sdf.gz"])
def test_sdf_scan(spark, tmp_path, suffix):
    broken = "BROKEN\nno table\n$$$$\n"
    text = ASPIRIN + broken + MOLECULE.format(name="", smiles="CCO", key="CHEMBL545")
    path = write(tmp_path / f"a.{suffix}", text)
    rows = {r["smiles"]: r for r in read_sdf(spark, path).collect()}
    # A record without a table is no molecule, but is there to be rejected.
    assert set(rows) == {"CC(=O)Oc1ccccc1C(=O)O", "CCO", None}
    assert rows[None]["external_id"] == "BROKEN"
    aspirin = rows["CC(=O)Oc1ccccc1C(=O)O"]
    assert aspirin["external_id"] == "ASPIRIN"
    assert aspirin["props"] == {"chembl_id": "CHEMBL113", "note": "two\nlines"}
    assert rows["CCO"]["external_id"] is None
    by_prop = read_sdf(spark, path, external_id_prop="chembl_id").collect()
    assert {r["external_id"] for r in by_prop if r["smiles"]} == {"CHEMBL113", "CHEMBL545"}


def test_sdf_with_windows_line_ends(spark, tmp_path):
    path = tmp_path / "w.sdf"
    more = "".join(MOLECULE.format(name=n, smiles=s, key=n) for n, s in [("", "CCO"), ("M2", "CCN")])
    path.write_bytes((ASPIRIN + more).replace("\n", "\r\n").encode())
    found = {(r["external_id"], r["smiles"]) for r in read_sdf(spark, str(path)).collect()}
    assert found == {("ASPIRIN", "CC(=O)Oc1ccccc1C(=O)O"), (None, "CCO"), ("M2", "CCN")}


def test_first_record_with_a_blank_name(spark, tmp_path):
    row = read_sdf(spark, write(tmp_path / "b.sdf", MOLECULE.format(name="", smiles="CCO", key="K"))).first()
    assert (row["external_id"], row["smiles"]) == (None, "CCO")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_names_whatever_the_comment_and_tag_say(spark, tmp_path, end):
    """Comments that name a version, counts without one, blank names at the start and later."""
    told = MOLECULE.replace("  prog\n\n", "  prog\nmade from V2000 files\n")
    bare = MOLECULE.replace("            999 V2000", "")
    records = [bare.format(name="", smiles="C", key="1"), told.format(name="M2", smiles="CC", key="2"), told.format(name="", smiles="CCC", key="3"), bare.format(name="M4", smiles="CCCC", key="4")]
    wanted = [(None, "C"), ("M2", "CC"), (None, "CCC"), ("M4", "CCCC")]
    for turn in range(4):
        path = tmp_path / f"n{turn}.sdf"
        path.write_bytes("".join(records[turn:] + records[:turn]).replace("\n", end).encode())
        found = {(r["external_id"], r["smiles"]) for r in read_sdf(spark, str(path)).collect()}
        assert found == set(wanted), turn


def test_molecules_without_structure_are_kept_for_rejection(spark, tmp_path):
    rows = read_sdf(spark, write(tmp_path / "n.sdf", ASPIRIN.replace("<SMILES>", "<OTHER>") * 3)).collect()
    assert [r["smiles"] for r in rows] == [None] * 3


def test_fasta_after_blank_lines(spark, tmp_path):
    assert [r["external_id"] for r in read_fasta(spark, write(tmp_path / "l.fasta", "\n \n" + INSULIN)).collect()] == ["P12345"]


def test_csv_with_quoted_line_ends(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,b\n1,"x\ny"\n2,z\n')
    assert [r["b"] for r in read_csv(spark, path, multi_line=True).sort("a").collect()] == ["x\ny", "z"]


def test_repeated_property_keeps_its_last_value(spark, tmp_path):
    text = ASPIRIN.replace("$$$$", "> <chembl_id>\nCHEMBL25\n\n$$$$")
    assert read_sdf(spark, write(tmp_path / "r.sdf", text)).first()["props"]["chembl_id"] == "CHEMBL25"


@pytest.mark.parametrize("suffix", ["fasta", "fasta.gz"])
def test_fasta_scan(spark, tmp_path, suffix):
    path = write(tmp_path / f"a.{suffix}", INSULIN + ">Q1\nAAAA\n" + ">EMPTY no letters\n")
    rows = {r["external_id"]: r for r in read_fasta(spark, path).collect()}
    assert rows["P12345"]["description"] == "P12345 Test Protein > odd"
    assert rows["P12345"]["sequence"] == "MKWVTFISLLFLFSSAYSRGVFRR"
    assert rows["Q1"]["sequence"] == "AAAA"
    assert rows["EMPTY"]["sequence"] == ""


def test_csv_scan_and_reader_choice(spark, tmp_path):
    path = write(tmp_path / "a.csv", "external_id,label\nI1,1\nI2,0\n")
    rows = read_csv(spark, path).select("external_id", "label").collect()
    assert [tuple(r) for r in rows] == [("I1", 1), ("I2", 0)]
    assert [r["label"] for r in read(spark, "CSV", path, schema="external_id string, label int").collect()] == [1, 0]
    with pytest.raises(ValueError, match="xlsx"):
        read(spark, "xlsx", path)


def test_catalogue_replaces_and_rejects_unknown(spark):
    register_source("twice", Source("twice", "/a", "sdf", "compound"))
    register_source("twice", Source("twice", "/b", "sdf", "compound", stats={"n": 3}))
    assert get_registered_source("twice").url == "/b"
    row = catalogue(spark).filter("name = 'twice'").first()
    assert row["url"] == "/b" and row["stats"] == {"n": "3"}
    with pytest.raises(ValueError, match="nowhere"):
        get_registered_source("nowhere")


def test_hashes_of_small_and_large_files_agree(spark, tmp_path, monkeypatch):
    import hashlib

    path = write(tmp_path / "x.bin", "some bytes" * 1000)
    want = hashlib.sha256(("some bytes" * 1000).encode()).hexdigest()
    assert hash_files(spark, path).first()["sha256"] == want
    monkeypatch.setattr("pairrank.sources.raw_files.INLINE_BYTES", 10)
    assert hash_files(spark, path).first()["sha256"] == want
    assert list_files(spark, path).first()["bytes"] == 10_000


def test_same_source_twice_is_one_row_and_two_runs(spark, tmp_path, root):
    register_source("mols", Source("mols", write(tmp_path / "in/m.sdf.gz", ASPIRIN), "sdf", "compound", "vTEST"))
    ingestion = Ingestion(spark, f"{root}/db", buckets=4)
    first = ingestion.run_pipeline("mols")
    before = ingestion.tables["compound"].read().first()
    ingestion.run_pipeline("mols")
    rows = ingestion.tables["compound"].read().collect()
    assert [(r["external_id"], r["smiles"]) for r in rows] == [("ASPIRIN", "CC(=O)Oc1ccccc1C(=O)O")]
    assert rows[0]["id"] == before["id"]
    assert [r["status"] for r in ingestion.runs().collect()] == ["COMPLETED", "COMPLETED"]
    assert ingestion.raw_files.read().count() == 1
    raw = ingestion.raw_files.read().first()
    assert raw["key"] == f"mols/vTEST/{first['checksums']['sha256']}/m.sdf.gz"
    stored = tmp_path / "db/raw" / raw["key"]
    assert gzip.decompress(stored.read_bytes()).decode() == ASPIRIN


def test_fasta_ingest_and_last_record_wins(spark, tmp_path, root):
    text = INSULIN + ">P12345 newer\nMMMM\n>\nNOID\n"
    register_source("prot", Source("prot", write(tmp_path / "in/p.fasta", text), "fasta", "protein"))
    ingestion = Ingestion(spark, f"{root}/db", buckets=4)
    run = ingestion.run_pipeline("prot")
    assert (run["rows_in"], run["rows_upserted"], run["rows_rejected"]) == (3, 2, 1)
    row = ingestion.tables["protein"].read().collect()
    assert [(r["sequence"], r["metadata"]) for r in row] == [("MMMM", {"description": "P12345 newer"})]
    assert ingestion.rejected.read().first()["reason"] == "missing external_id"


def test_failed_run_is_logged_and_raised(spark, root):
    register_source("lost", Source("lost", f"{root}/nothing-here", "sdf", "compound", stats={"n": 1}))
    ingestion = Ingestion(spark, f"{root}/db", buckets=4)
    with pytest.raises(Exception, match="nothing-here"):
        ingestion.run_pipeline("lost")
    run = ingestion.runs().first()
    assert run["status"] == "FAILED" and "nothing-here" in run["error"]
    assert run["ended_at"] is not None and run["stats"] == '{"n": 1}'
    with pytest.raises(ValueError):
        ingestion.run_pipeline("never registered")


def test_interaction_ingest_resolves_parents(spark, tmp_path, root):
    ingestion = Ingestion(spark, f"{root}/db", buckets=4)
    register_source("mols", Source("mols", write(tmp_path / "in/m.sdf", ASPIRIN), "sdf", "compound"))
    register_source("prot", Source("prot", write(tmp_path / "in/p.fasta", INSULIN), "fasta", "protein"))
    text = (
        "external_id,compound_external_id,compound_source,protein_external_id,protein_source,label\n"
        "I1,ASPIRIN,mols,P12345,prot,1\nI2,ASPIRIN,mols,P999,prot,0\nI3,X,mols,P12345,prot,0\n"
    )
    register_source("pairs", Source("pairs", write(tmp_path / "in/i.csv", text), "CSV", "interaction"))
    for name in ("mols", "prot", "pairs"):
        ingestion.run_pipeline(name)
    got = ingestion.tables["interaction"].read().collect()
    assert [(r["external_id"], r["label"], r["interaction_type"]) for r in got] == [("I1", 1, "binds")]
    assert got[0]["compound_id"] == ingestion.tables["compound"].read().first()["id"]
    reasons = {r["external_id"]: r["reason"] for r in ingestion.rejected.read().collect()}
    assert reasons == {"I2": "unknown protein", "I3": "unknown compound"}


def test_unknown_entity_type(spark, tmp_path, root):
    register_source("odd", Source("odd", write(tmp_path / "in/o.csv", "external_id\nA\n"), "csv", "antibody"))
    with pytest.raises(ValueError, match="antibody"):
        Ingestion(spark, f"{root}/db").run_pipeline("odd")


def test_stream_loads_each_file_once(spark, tmp_path, root):
    ingestion = Ingestion(spark, f"{root}/db", buckets=4)
    inbox = tmp_path / "inbox"
    first = write(inbox / "a.fasta", ">P1 old\nAAA\n>P2\nCCC\n")
    os.utime(first, (1_000, 1_000))
    source = Source("stream", str(inbox), "fasta", "protein")

    def run():
        query = ingest_stream(ingestion, "stream", source, f"{root}/checkpoint")
        assert query.awaitTermination(120)

    run()
    assert {r["external_id"] for r in ingestion.tables["protein"].read().collect()} == {"P1", "P2"}
    write(inbox / "b.fasta", ">P1 new\nGGG\n")
    run()
    run()
    rows = {r["external_id"]: r["sequence"] for r in ingestion.tables["protein"].read().collect()}
    assert rows == {"P1": "GGG", "P2": "CCC"}
    runs = ingestion.runs().collect()
    assert sorted((r["batch_id"], r["rows_in"], r["status"]) for r in runs) == [(0, 2, "COMPLETED"), (1, 1, "COMPLETED")]


def test_upsert_touches_only_its_partitions(spark, tmp_path, root):
    ingestion = Ingestion(spark, f"{root}/db", buckets=8)
    table = ingestion.tables["protein"]
    rows = spark.range(200).select(
        F.concat(F.lit("id"), "id").alias("id"), F.lit("s").alias("source"),
        F.col("id").cast("string").alias("external_id"), F.lit("AAA").alias("sequence"),
        F.create_map(F.lit("description"), F.lit(None).cast("string")).alias("metadata"),
    )
    table.upsert(rows)
    old = table.snapshot().folders
    assert sorted(old) == list(range(8)) and all((tmp_path / "db/tables/proteins" / f).is_dir() for f in old.values())
    table.upsert(rows.filter("external_id = '7'").withColumn("sequence", F.lit("NEW")).withColumn("id", F.lit("other")))
    new = table.snapshot().folders
    assert sum(old[b] == new[b] for b in old) == 7
    got = {r["external_id"]: (r["id"], r["sequence"]) for r in table.read().collect()}
    assert len(got) == 200 and got["7"] == ("id7", "NEW") and got["8"] == ("id8", "AAA")


def test_replayed_batch_after_a_failure(spark, tmp_path, root, monkeypatch):
    ingestion = Ingestion(spark, f"{root}/db", buckets=4)
    inbox = tmp_path / "inbox"
    write(inbox / "a.sdf", ASPIRIN + MOLECULE.format(name="ETHANOL", smiles="CCO", key="CHEMBL545"))
    source = Source("stream", str(inbox), "SDF", "compound")
    good = Ingestion.load

    def broken(*_):
        raise OSError("disk gone")

    monkeypatch.setattr(Ingestion, "load", broken)
    with pytest.raises(Exception, match="disk gone"):
        ingest_stream(ingestion, "stream", source, f"{root}/checkpoint").awaitTermination(120)
    failed = ingestion.runs().first()
    assert (failed["status"], failed["batch_id"]) == ("FAILED", 0) and "disk gone" in failed["error"]
    assert ingestion.tables["compound"].read().count() == 0

    monkeypatch.setattr(Ingestion, "load", good)
    assert ingest_stream(ingestion, "stream", source, f"{root}/checkpoint").awaitTermination(120)
    assert {r["external_id"] for r in ingestion.tables["compound"].read().collect()} == {"ASPIRIN", "ETHANOL"}
    assert [r["status"] for r in ingestion.runs().collect()] == ["COMPLETED"]

    # The engine may run a completed batch again; then nothing is loaded twice.
    monkeypatch.setattr(Ingestion, "load", broken)
    (tmp_path / "checkpoint/commits/0").unlink()
    for leftover in (tmp_path / "checkpoint/commits").glob(".0*.crc"):
        leftover.unlink()
    assert ingest_stream(ingestion, "stream", source, f"{root}/checkpoint").awaitTermination(120)


def test_csv_stream_needs_a_schema_and_keeps_order(spark, tmp_path, root):
    ingestion = Ingestion(spark, f"{root}/db", buckets=4)
    source = Source("csvs", str(tmp_path / "inbox"), "csv", "protein")
    with pytest.raises(ValueError, match="schema"):
        ingest_stream(ingestion, "csvs", source, f"{root}/checkpoint")
    write(tmp_path / "inbox/a.csv", "external_id,sequence\nP1,AAA\nP1,CCC\n,GGG\n")
    query = ingest_stream(ingestion, "csvs", source, f"{root}/checkpoint", schema="external_id string, sequence string")
    assert query.awaitTermination(120)
    assert [(r["external_id"], r["sequence"]) for r in ingestion.tables["protein"].read().collect()] == [("P1", "CCC")]
    assert ingestion.rejected.read().count() == 1


def test_many_records_over_many_splits(spark, tmp_path):
    """A file cut into small splits gives every record once, in its own order."""
    molecules = "".join(MOLECULE.format(name=f"M{i}", smiles="C" * (i % 40 + 1), key=f"K{i}") for i in range(3000))
    sequences = "".join(f">P{i} number {i}\n" + "ACDEFGHIKL" * (i % 9) + "\nM\n" for i in range(3000))
    sdf, fasta = write(tmp_path / "many.sdf", molecules), write(tmp_path / "many.fasta", sequences)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = read_sdf(spark, sdf)
        assert found.rdd.getNumPartitions() > 10
        got = {r["external_id"]: (r["smiles"], r["props"]["chembl_id"]) for r in found.collect()}
        assert got == {f"M{i}": ("C" * (i % 40 + 1), f"K{i}") for i in range(3000)}
        rows = read_fasta(spark, fasta).orderBy("_file", "_block", "_place").collect()
        assert [r["external_id"] for r in rows] == [f"P{i}" for i in range(3000)]
        assert all(r["sequence"] == "ACDEFGHIKL" * (i % 9) + "M" for i, r in enumerate(rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_last_wins_with_a_hot_key(spark):
    from pairrank.operators.keyed import last_wins

    rows = spark.range(0, 30_000, 1, 8).select(
        F.lit("s").alias("source"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("external_id"),
        F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("value"), F.col("id").alias("at"),
    )
    picked = last_wins(rows, ["at"])
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan
    got = {r["external_id"]: (r["value"], r["at"]) for r in picked.collect()}
    assert len(got) == 20_001
    # The latest row wins whole, its nulls included.
    assert got["hot"] == (None, 29_997) and got["29999"] == (None, 29_999)


def test_upsert_replaces_with_nulls_and_keeps_the_rest(spark):
    from pairrank.operators.keyed import duplicate_keys, merge_payload, missing_parents

    ddl = "id string, source string, external_id string, smiles string"
    old = spark.createDataFrame([("1", "s", "A", "C"), ("2", "s", "B", "CC")], ddl)
    new = spark.createDataFrame([("x", "s", "A", None), ("y", "s", "N", "O")], ddl)
    got = sorted(map(tuple, merge_payload(old, new, ["smiles"]).collect()))
    assert got == [("1", "s", "A", None), ("2", "s", "B", "CC"), ("y", "s", "N", "O")]
    assert duplicate_keys(old.union(new)).collect()[0]["n_rows"] == 2
    children = spark.createDataFrame([("1",), ("9",), (None,)], "parent string")
    assert [r[0] for r in missing_parents(children, old, "parent").collect()] == ["9"]


def test_records_to_rows(spark):
    from pairrank.operators.records import to_rows

    records = spark.createDataFrame([("A", "x"), ("", "y"), (None, ""), (None, None)], "external_id string, source_id string")
    rows = to_rows(records, "s", "compound").collect()
    assert [r["external_id"] for r in rows] == ["A", "y", None, None]
    with pytest.raises(ValueError):
        to_rows(records, "s", "antibody")
    filled = to_rows(records, "s", "interaction").first()
    assert (filled["interaction_type"], filled["label"], filled["affinity_value"]) == ("binds", 1, None)


# ------------------------------------------------------------------ versions of a table

COMPOUND = "id string, source string, external_id string, smiles string, metadata map<string,string>"


def compound_rows(spark, smiles, keys):
    return spark.createDataFrame([(f"i{k}", "s", f"K{k}", smiles, {"a": "b"}) for k in keys], COMPOUND)


def compound_table(spark, root, buckets=8):
    return KeyedTable(spark, f"{root}/t", COMPOUND, ["smiles", "metadata"], buckets)


def held_rows(table, version=None):
    return {r["external_id"]: r["smiles"] for r in table.read(version).collect()}


def test_versions_are_snapshots(spark, root):
    table = compound_table(spark, root)
    assert table.read().count() == 0 and table.versions() == []
    first = table.upsert(compound_rows(spark, "C", range(50)))
    before = table.read()
    second = table.upsert(compound_rows(spark, "N", range(40, 60)))
    assert (first, second, table.versions()) == (0, 1, [0, 1])
    assert held_rows(table, 0) == {f"K{k}": "C" for k in range(50)}
    assert held_rows(table) == {**{f"K{k}": "C" for k in range(40)}, **{f"K{k}": "N" for k in range(40, 60)}}
    # A reader of the older version is not disturbed by the newer one.
    assert {r["smiles"] for r in before.collect()} == {"C"} and before.count() == 50
    assert table.upsert(compound_rows(spark, "X", [])) == 1
    with pytest.raises(ValueError, match="no version 7"):
        table.read(7)


def test_bucket_count_is_the_stored_one(spark, root):
    compound_table(spark, root, 8).upsert(compound_rows(spark, "C", range(50)))
    other = compound_table(spark, root, 3)
    other.upsert(compound_rows(spark, "N", range(50)))
    assert held_rows(other) == {f"K{k}": "N" for k in range(50)}
    assert other.snapshot().buckets == 8 and other.read().count() == 50


def test_a_crash_before_the_commit_changes_nothing(spark, root, monkeypatch):
    table = compound_table(spark, root)
    table.upsert(compound_rows(spark, "C", range(50)))
    folders = set(table.snapshot().folders.values())

    def dies(*_):
        raise OSError("power cut")

    with monkeypatch.context() as patch:
        patch.setattr(KeyedTable, "_commit", dies)
        with pytest.raises(OSError, match="power cut"):
            table.upsert(compound_rows(spark, "N", range(50)))
    again = compound_table(spark, root)
    assert held_rows(again) == {f"K{k}": "C" for k in range(50)} and again.versions() == [0]
    assert again.vacuum(older_than_hours=24) == 0
    assert again.vacuum(older_than_hours=0) == 8
    assert set(again.snapshot().folders.values()) == folders
    again.upsert(compound_rows(spark, "N", range(50)))
    assert set(held_rows(again).values()) == {"N"}
    assert again.vacuum(keep=2, older_than_hours=0) == 0 and again.versions() == [0, 1]
    assert again.vacuum(keep=1, older_than_hours=0) == 8 and again.versions() == [1]
    assert again.read().count() == 50


@pytest.mark.parametrize("overlap", [True, False])
def test_two_writers(spark, root, monkeypatch, overlap):
    """The second commits while the first merges: no row of either is lost, whether or not they share buckets."""
    table, other = compound_table(spark, root, 64), compound_table(spark, root, 64)
    table.upsert(compound_rows(spark, "C", range(20)))
    bucket = {r["external_id"]: r["b"] for r in table.read().select("external_id", table.bucket_of(64).alias("b")).collect()}
    mine = "K0"
    theirs = mine if overlap else next(k for k, b in bucket.items() if b != bucket[mine])
    merge, merges = KeyedTable._merge, []

    def slow(self, updates, base):
        made = merge(self, updates, base)
        merges.append(self is table)
        if self is table and len(merges) == 1:
            other.upsert(compound_rows(spark, "theirs", [int(theirs[1:]), 100]))
        return made

    monkeypatch.setattr(KeyedTable, "_merge", slow)
    assert table.upsert(compound_rows(spark, "mine", [0, 200])) == 2
    # The merged buckets are used as they are where the other writer left them alone.
    assert sum(merges) == (2 if overlap else 1)
    wanted = {**{f"K{k}": "C" for k in range(20)}, "K100": "theirs", "K200": "mine", theirs: "theirs", mine: "mine"}
    assert held_rows(table) == wanted
    assert table.versions() == [0, 1, 2]


def test_only_one_writer_publishes_a_version(spark, root):
    from pairrank.sources.files import entries, publish, read_text

    assert publish(spark, f"{root}/v/1.json", "a") and not publish(spark, f"{root}/v/1.json", "b")
    assert read_text(spark, f"{root}/v/1.json") == "a"
    assert [name for name, _ in entries(spark, f"{root}/v") if not name.startswith(".")] == ["1.json"]


def test_a_repeated_load_rejects_its_rows_once(spark, tmp_path, root):
    ingestion = Ingestion(spark, f"{root}/db", buckets=4)
    path = write(tmp_path / "in/m.sdf", ASPIRIN + ASPIRIN.replace("<SMILES>", "<OTHER>").replace("ASPIRIN", "LOST"))
    for _ in range(2):
        ingestion.load(read_sdf(spark, path), "mols", "compound", "run1")
    assert [(r["external_id"], r["run_id"]) for r in ingestion.rejected.read().collect()] == [("LOST", "run1")]
    ingestion.load(read_sdf(spark, path), "mols", "compound", "run2")
    assert {r["run_id"] for r in ingestion.rejected.read().collect()} == {"run1", "run2"}


def test_stages_of_a_run_are_timed(spark, tmp_path, root):
    from pairrank.operators.aggregates import batch_histogram, stage_histogram

    register_source("timed", Source("timed", write(tmp_path / "in/m.sdf", ASPIRIN), "sdf", "compound"))
    ingestion = Ingestion(spark, f"{root}/db", buckets=4)
    run = ingestion.run_pipeline("timed")
    assert set(run["stages"]) == {"store", "parse", "upsert", "reject"} and all(v > 0 for v in run["stages"].values())
    last = [r for r in stage_histogram(ingestion.runs()).collect() if r["le"] == "+Inf"]
    assert {(r["stage"], r["bucket_count"]) for r in last} == {(s, 1) for s in run["stages"]}
    rows = {r["le"]: r["bucket_count"] for r in batch_histogram(ingestion.runs()).collect()}
    assert rows["10"] == 1 and rows["+Inf"] == 1


def test_checksums_are_those_of_the_run(spark, tmp_path, root):
    ingestion = Ingestion(spark, f"{root}/db", buckets=4)
    seen = []
    for name, text in (("a", ASPIRIN), ("b", ASPIRIN.replace("ASPIRIN", "OTHER"))):
        register_source("sums", Source("sums", write(tmp_path / f"{name}/m.sdf", text), "sdf", "compound", "v1"))
        seen.append(ingestion.run_pipeline("sums")["checksums"])
    assert all(set(c) == {"sha256"} for c in seen) and seen[0] != seen[1]


# ------------------------------------------------------------------ record data sources


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [7, 61, 1000, 10**6])
def test_ranges_give_each_record_once(tmp_path, split, end):
    """Blank names first and later, separators with blanks after them, and no separator at the end."""
    from pairrank.sources import record_source

    text = "".join(MOLECULE.format(name="" if k % 3 == 0 else f"M{k}", smiles="C" * (k + 1), key=f"K{k}") for k in range(9))
    text = (text.replace("$$$$", "$$$$  ", 2) + "LAST\n").replace("\n", end)
    path = tmp_path / "a.sdf"
    path.write_bytes(text.encode())
    ranges = record_source._ranges(record_source._files(str(path)), split)
    got = [r for part in ranges for r in record_source.records(part, "sdf")]
    assert [o for o, _ in got] == sorted({o for o, _ in got}) and len(got) == 10
    assert [r.decode().split(end)[0] for _, r in got] == ["" if k % 3 == 0 else f"M{k}" for k in range(9)] + ["LAST"]
    assert all(text.encode()[o:o + len(r)] == r for o, r in got)

    fasta = tmp_path / "a.fasta"
    fasta.write_bytes(("".join(f">P{k} x > y\nAC\n\nGT{'A' * k}\n" for k in range(20))).replace("\n", end).encode())
    got = [r for part in record_source._ranges(record_source._files(str(fasta)), split) for r in record_source.records(part, "fasta")]
    assert [r.split(b" ")[0] for _, r in got] == [f">P{k}".encode() for k in range(20)]


def test_sdf_data_source(spark, tmp_path):
    from pairrank.sources.readers import parse_fasta, parse_sdf
    from pairrank.sources.record_source import register_record_sources

    register_record_sources(spark)
    records = [MOLECULE.format(name="", smiles="C", key="1"), ASPIRIN, MOLECULE.format(name="", smiles="CCC", key="3")]
    write(tmp_path / "in/a.sdf", "".join(records))
    write(tmp_path / "in/b.sdf.gz", "".join(records).replace("\n", "\r\n"))
    write(tmp_path / "in/_skipped.sdf", ASPIRIN)
    wanted = [(None, "C"), ("ASPIRIN", "CC(=O)Oc1ccccc1C(=O)O"), (None, "CCC")]
    for path, times in ((f"{tmp_path}/in", 2), (f"{tmp_path}/in/*.sdf", 1), ((tmp_path / "in/b.sdf.gz").as_uri(), 1)):
        rows = parse_sdf(spark.read.format("sdf").option("splitBytes", 100).load(path), "record").orderBy("file", "offset").collect()
        assert [(r["external_id"], r["smiles"]) for r in rows] == wanted * times
    (tmp_path / "none").mkdir()
    assert spark.read.format("sdf").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("sdf").load(str(tmp_path / "nowhere")).count()
    path = write(tmp_path / "p.fasta", INSULIN)
    assert parse_fasta(spark.read.format("fasta").load(path), "record").first()["sequence"] == "MKWVTFISLLFLFSSAYSRGVFRR"


def test_stream_of_records(spark, tmp_path):
    from pairrank.sources.record_source import register_record_sources

    register_record_sources(spark)
    taken = []

    def run():
        rows = spark.readStream.format("fasta").load(str(tmp_path / "inbox"))
        stream = rows.writeStream.foreachBatch(lambda batch, _: taken.extend(r["record"].split("\n")[0] for r in batch.collect()))
        assert stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)

    first = write(tmp_path / "inbox/a.fasta", ">P1\nAA\n>P2\nCC\n")
    os.utime(first, (1_000, 1_000))
    run()
    assert taken == [">P1", ">P2"]
    write(tmp_path / "inbox/b.fasta", ">P3\nGG\n")
    run()
    run()
    assert taken == [">P1", ">P2", ">P3"]


def test_interactions_stay_where_they_are_for_counted_parents(spark):
    """Parents that fit are broadcast past Spark's own estimate; where broadcasts are forbidden they are not."""
    from pairrank.operators import keyed

    parents = spark.createDataFrame([(f"id{k}", str(k), "s") for k in range(50)], "id string, external_id string, source string")
    rows = spark.range(400).selectExpr(
        "CAST(id % 60 AS string) AS compound_external_id", "'s' AS compound_source", "CAST(id % 50 AS string) AS protein_external_id", "'s' AS protein_source",
    )
    results = []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold, name in (("1", "BroadcastHashJoin"), ("-1", "SortMergeJoin")):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            found = keyed.resolve_interactions(rows, parents, parents)
            assert found._jdf.queryExecution().sparkPlan().toString().count(name) == 2
            results.append(sorted(map(str, found.collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert results[0] == results[1] and len(results[0]) == 400
