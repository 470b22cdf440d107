"""Every core query against its SQL, and the contract, exchange files and semantics by literal values."""

import datetime as dt
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import verify_local
from shalework.functions import text as X
from shalework.operators import contract, profile
from shalework.operators import semantics as M
from shalework.plans import catalog, general
from shalework.sources import exchange


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).iterdir():
        c.sql(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, sf, name):
    said = verify_local.compare(spark, con, name, sf)
    assert ": ok" in said, said


def test_other_queries_run(spark, sf):
    for name in ("x_tables", "x_objects", "s2_ingest_errors", "x_code_census"):
        assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_entry_has_a_stable_schema():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


# --- contract -----------------------------------------------------------------------------------------------------

INDEX = "file string, kind string, id string, name string, folder string, path string, sha256 string, lines string, ord long"
ROWS = [
    ("A.fmp12", "scripts", "1", "one", "", "A/scripts/1.txt", "h1", "10", 0), ("A.fmp12", "scripts", "2", "two", "", "A/scripts/2.txt", "h2", "7000", 1), ("A.fmp12", "scripts", "3", "three", "", "A/scripts/3.txt", "h3", "", 2),
    ("B.fmp12", "scripts", "1", "one", "F", "B/scripts/1.txt", "h4", "5", 3), ("A.fmp12", "tables", "1", "t", "", "A/tables/1.txt", "h5", "9", 4), ("A.fmp12", "base-directories", "5", "d", "", "A/bd/5a.txt", "h6", "1", 5), ("A.fmp12", "base-directories", "5", "e", "", "A/bd/5b.txt", "h7", "1", 6),
]


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame(ROWS, INDEX)


def entries(index, *kinds, size=50, lines=6000):
    return {r.source_id: (r.output_file.rsplit("/", 1)[1], r.lines) for r in contract.build_entries(index, list(kinds), size, lines).collect()}


def test_batches_close_by_size_and_lines(index):
    assert entries(index, "scripts") == {"A/scripts/1.txt": ("_root-001.csv", 10), "A/scripts/2.txt": ("_root-002.csv", 7000), "A/scripts/3.txt": ("_root-003.csv", 0), "B/scripts/1.txt": ("F--f67ab10a-001.csv", 5)}
    assert len({r.output_file for r in contract.build_entries(index, ["scripts"], 1).collect()}) == 4
    assert len(entries(index, "tables", "base-directories")) == 3
    assert contract.absent_kinds(index, ["scripts", "menus"]) == ["menus"]
    with pytest.raises(exchange.ContractError):
        contract.absent_kinds(index, ["menus"])
    with pytest.raises(exchange.ContractError, match="more than once"):
        contract.check_unique(contract.build_entries(index.union(index), ["tables"]))


def test_coverage_buckets(spark, index):
    e = contract.build_entries(index, ["scripts"]).cache()
    good = e.select("source_id", "source_hash", "output_file")
    assert contract.check_coverage(e, good) == 4
    buckets = lambda o: {(r.bucket, r.source_id) for r in contract.coverage(e, o).collect()}
    assert buckets(good.where("source_id <> 'A/scripts/1.txt'")) == {("missing", "A/scripts/1.txt")}
    assert buckets(good.union(good.where("source_id = 'A/scripts/2.txt'"))) == {("duplicates", "A/scripts/2.txt")}
    assert buckets(good.withColumn("source_hash", F.when(F.col("source_id") == "A/scripts/3.txt", "zz").otherwise(F.col("source_hash")))) == {("wrong_hash", "A/scripts/3.txt")}
    one_file = good.withColumn("output_file", F.lit("all.csv"))
    with pytest.raises(exchange.ContractError, match="wrong_file=4"):
        contract.check_coverage(e, one_file)
    extra = spark.createDataFrame([("new", "h", "f"), (None, "h", "f")], "source_id string, source_hash string, output_file string")
    assert buckets(good.union(extra)) == {("extra", "new"), ("extra", None)}
    share = e.where("source_id like 'B%'").select("output_file")
    assert contract.check_coverage(e, good, share) == 1
    with pytest.raises(exchange.ContractError, match="no classification"):
        contract.check_coverage(e, good.limit(0))


def test_longest_first(spark):
    b = spark.createDataFrame([("c", f"b{i}", n, i) for i, n in enumerate([9, 7, 7, 5, 3, 3, 1])], "catalog string, output_file string, lines long, ord long")
    assert {r.output_file: r.agent for r in contract.spread(b, 2).collect()} == {"b0": 1, "b1": 2, "b2": 2, "b3": 1, "b4": 1, "b5": 2, "b6": 1}


def test_exchange_files(spark, index, tmp_path):
    text = "\n".join(["\t".join(c.split(" ")[0] for c in exchange.INDEX.split(", ")), *("\t".join(map(str, r[:8])) for r in ROWS), 'C.fmp12\tscripts\t9\t"odd name\t\tC/9.txt\th\t1'])
    (tmp_path / "index.tsv").write_text(text)
    back = exchange.read_index(spark, str(tmp_path / "index.tsv"))
    assert back.count() == 8 and back.where("name like '\"odd%'").count() == 1
    (tmp_path / "bad.tsv").write_text("file\tkind\nA\tb")
    with pytest.raises(exchange.ContractError, match="lacks required"):
        exchange.read_index(spark, str(tmp_path / "bad.tsv"))
    root = tmp_path / "csv" / "scripts" / "A"
    root.mkdir(parents=True)
    (root / "x-001.csv").write_text('source_id,source_hash,note\r\n"a,1",h,"two\nlines ""q"""\r\nb,h2,\r\n')
    (root / "y-001.csv").write_text("note,source_id,source_hash\nn,c,h3\n")
    got = {tuple(r) for r in exchange.read_classifications(spark, str(tmp_path / "csv")).collect()}
    assert got == {("a,1", "h", "scripts/A/x-001.csv"), ("b", "h2", "scripts/A/x-001.csv"), ("c", "h3", "scripts/A/y-001.csv")}
    (root / "z.csv").write_text("id,hash\n1,2\n")
    with pytest.raises(exchange.ContractError, match="z.csv lacks"):
        exchange.read_classifications(spark, str(tmp_path / "csv"))


def test_catalog_snapshots(spark, index, tmp_path):
    at, meta = str(tmp_path / "cat"), {"kinds": ["scripts"], "batch_size": 50, "batch_lines": 6000}
    e = contract.build_entries(index, ["scripts"])
    assert exchange.write_catalog(e, meta, at) == "written" and exchange.write_catalog(e, meta, at) == "unchanged"
    changed = contract.build_entries(index.withColumn("name", F.upper("name")), ["scripts"])
    with pytest.raises(exchange.ContractError, match="changed"):
        exchange.write_catalog(changed, meta, at)
    stored = exchange.read_catalog(spark, at)[1]
    contract.check_fresh(stored, e)
    with pytest.raises(exchange.ContractError, match="stale"):
        contract.check_fresh(stored, changed)
    assert exchange.write_catalog(changed, meta, at, force=True) == "written"
    shares = contract.assign({"cat": e}, 2)
    exchange.write_assignments(shares, str(tmp_path / "shares"))
    mine = exchange.read_assignment(spark, str(tmp_path / "shares" / "agent=1"))
    assert set(mine.columns) == set(exchange.ASSIGNMENT) and 0 < mine.count() < 4
    assert contract.share_of(mine, ["tables"]).count() == 0
    assert exchange.catalog_json(e, meta).count() == 5


# --- text and semantics -------------------------------------------------------------------------------------------


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(X.slug(lit("a/b:c*?.txt."))) == "a_b_c_.txt" and one(X.slug(lit("  "))) == "unnamed" and one(X.slug(lit("Élève 日本"))) == "Élève_日本"
    assert len(one(X.slug(lit("あ" * 100), 80))) == 66 and one(X.slug(lit(None).cast("string"))) is None
    assert one(X.path_list(lit("file:My Data fmnet:/*/My Data\nfilemac:/HD/x/Data.fmp12"))) == ["file:My Data", "fmnet:/*/My Data", "filemac:/HD/x/Data.fmp12"]
    assert [one(X.path_target(lit(p))) for p in ("file:Data", "fmnet:/*/Data/", "filewin:/C:/x/My Data.fmp12", "Data", "file:")] == ["Data", "Data", "My Data.fmp12", "Data", ""]
    assert [one(X.strip_extension(lit(p))) for p in ("Data.fmp12", "Data.FP7", "Mini.Schema", ".fmp12")] == ["Data", "Data", "Mini.Schema", ".fmp12"]
    assert one(X.live_code(lit('a "b\\" c" // d\ne /* f */ g “h” "' + "x" * 9000))) == 'a " "\ne " g " "'
    assert one(X.css_props(lit("a {\n color: red;\n}\n b: c;"))) == "color: red; b: c;" and one(X.snake(lit("CustomerName2"))) == "customer_name_2"
    assert one(X.bare(lit(' "a" '))) == "a" and one(X.quoted(lit("a\nb c"))) == '"a¶b c"' and one(X.normal(lit(" “a” …\n b"))) == '"a"b'
    assert one(X.lines_of(lit("a\r\nb\rc\u2028d"))) == ["a", "b", "c", "d"] and one(X.char_of(lit("44"))) == "," and one(X.char_of(lit("56144"))) == "U+DB50"
    assert one(X.file_key(lit(" A.FMP12 "))) == "a" and one(X.blank(lit("\u3000"))) is True


def test_found_sets_with_nulls(spark):
    t = M.FoundSet(spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id int, n int"))
    ids = lambda s: [r.id for r in s.sort(F.col("id")).rows().collect()]
    big = t.find([F.col("n") > 6])
    assert ids(big) == [3] and ids(big.show_omitted()) == [1, 2] and ids(big.show_all()) == [1, 2, 3] and ids(big.extend([F.col("n").isNull()])) == [2, 3] and ids(t.omit(F.col("n") > 6)) == [1, 2]
    assert [r.n for r in big.replace_contents("n", F.lit(0)).orderBy("id").collect()] == [5, None, 0]


def test_rules_masks_types(spark):
    df = spark.createDataFrame([(1, " ", "x1", "abc"), (2, "a", "7", None)], "id int, a string, b string, c string")
    rules = [M.Rule("a", "not_empty"), M.Rule("b", "type", ("int",)), M.Rule("c", "length", (2,))]
    assert sorted(tuple(r) for r in M.violations(df, rules, ["id"]).collect()) == [(1, "a", "not_empty"), (1, "b", "type"), (1, "c", "length")]
    assert [tuple(r) for r in M.multikey(spark.createDataFrame([(1, "a\r\nb\n\nb¶c")], "k int, v string"), "k", "v").collect()] == [(1, "a"), (1, "b"), (1, "c")]
    assert M.spark_type("TimeStamp") == "timestamp_ntz" and M.spark_type("Text", 3) == "array<string>"
    with pytest.raises(ValueError):
        M.spark_type("Timestamp")
    M.globals_of(spark, {"g_user": "x"})
    assert spark.sql("SELECT g_user").first()[0] == "x"


def test_profiles_of_odd_rows(spark):
    df = spark.createDataFrame([("a", None), ("a", 1.0), (None, 2.0)], "s string, n double")
    p = {r.column: tuple(r)[1:] for r in profile.profile_columns(df).collect()}
    assert p["s"] == (3, 1, 1, "a", "a", 1) and p["n"][:3] == (3, 1, 2)
    assert profile.checksum(df, ["s", "n"]).first() == profile.checksum(df.orderBy("n"), ["s", "n"]).first()
    a, b = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "x"), (2, None)], [(1, "y"), (3, "z")]))
    assert sorted(tuple(r) for r in profile.changed_rows(a, b, ["k"], ["v"]).collect()) == [(1, "v"), (2, "rejected"), (3, "unexpected")]
    e = profile.edge_values(spark.createDataFrame([(dt.datetime(1969, 1, 1),)], "t timestamp_ntz"), [], [], ["t"]).collect()
    assert {r.edge: r.n for r in e} == {"midnight": 1, "before 1970": 1}


def test_only_problems_have_p_names():
    import re

    assert {n for n in catalog.QUERIES if re.match(r"p\d+_", n)} == {"p1_found", "p1_report", "p2_found", "p2_summary", "p6_found", "p6_records", "p6_failures"} | set(general.TABLES)


def test_names_and_keys_of_every_snapshot(spark, tmp_path):
    rows = [(n, f"p{i}", f"Name / {n}-{i}") for n in (1, 5, 6, 7) for i in range(3)] + [(7, "p1", "Name / 7-1"), (2, "q", None), (2, "q", "b")]
    spark.createDataFrame(rows, "snapshot_no int, path string, name string").write.parquet(f"{tmp_path}/object_index.parquet")
    q = catalog.QUERIES
    slugs = {(r.snapshot_no, r.path, r.name) for r in q["f1_slug_all"](spark, str(tmp_path)).collect()}
    assert slugs == set(rows)
    assert sorted(tuple(r) for r in q["a6_multiplicity_all"](spark, str(tmp_path)).collect()) == [(2, "q", 2), (7, "p1", 2)]
