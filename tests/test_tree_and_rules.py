"""Trees listed and read in ranges, and ignore rules as a table, against whole files and one expression."""

import random

from pyspark.sql import functions as F

from sparkloom.operators import scan
from sparkloom.sources import tree

KEY = "AKIA" + "ABCDEFGHIJKLMNOP"


def write(root, files):
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)


def test_listing_sees_hidden_files_at_any_depth(spark, tmp_path):
    names = [".env", "a/b/c/d/e.txt", "_x/y", ".git/config", "a/.git/z", "k/empty"]
    write(tmp_path, {n: b"x" * i for i, n in enumerate(names)})
    (tmp_path / "hollow").mkdir()
    want = {".env": 0, "a/b/c/d/e.txt": 1, "_x/y": 2, "k/empty": 5}
    for root in (str(tmp_path), f"file://{tmp_path}"):
        assert {r["path"]: r["size"] for r in tree.listing(spark, root).collect()} == want
    (tmp_path / "void").mkdir()
    assert tree.listing(spark, str(tmp_path / "void")).count() == 0 == tree.findings(spark, str(tmp_path / "void")).count()


def test_ranges_find_what_whole_texts_hold(spark, tmp_path):
    """Secrets over range borders, every kind of line end, also cut in two, and binary files."""
    rng = random.Random(2)
    files = {}
    for k in range(6):
        lines = [rng.choice(["x" * rng.randint(0, 70), f"key {KEY}", 'password = "hunter22"', 'token = "changeme12"', f'secret: "abcdefgh{k}" {KEY}', "é" * 9, ""]) for _ in range(300)]
        files[f"d{k % 2}/f{k}"] = "".join(x + rng.choice(["\n", "\r\n", "\r"]) for x in lines).encode()
    files["bin"] = b"\n" * 500 + KEY.encode() + b"\n" * 300 + b"\0"
    write(tmp_path, files)
    texts = spark.createDataFrame([(n, b.decode()) for n, b in files.items()], "path string, text string")
    want = sorted(map(tuple, scan.findings_of_lines(texts).collect()))
    assert len(want) > 500
    for size in (64, 1000, 1 << 20):
        assert sorted(map(tuple, tree.findings(spark, str(tmp_path), range_bytes=size).collect())) == want


def test_a_secret_behind_many_megabytes(spark, tmp_path):
    write(tmp_path, {"big.log": b"a line of nothing\n" * 400_000 + KEY.encode() + b"\n"})
    assert [tuple(r) for r in tree.findings(spark, str(tmp_path), range_bytes=1 << 20).collect()] == [("big.log", "high", "Possible AWS access key ID found", 400_001)]


def test_rules_from_a_file_decide_as_one_expression_does(spark, tmp_path):
    lines = ["# c", "", "*.log", "!keep.log", "build/", "/top", "a/**/z", "x[!0-9]y", "q[", "d?t", "*.tar.gz", "!/src/keep/*.gz", "deep/er/", "b*d", " trail  ", "src/**"]
    (tmp_path / ".gitignore").write_text("\n".join(lines) + "\n")
    assert tree.ignore_lines(str(tmp_path)) == lines and tree.ignore_lines(str(tmp_path / "none")) == []
    rng = random.Random(5)
    names = ["a", "z", "build", "top", "keep.log", "a.log", "xay", "x1y", "q[", "dot", "doot", "v.tar.gz", "src", "keep", "deep", "er", "bad", "c.gz", " trail", "é.log"]
    paths = sorted({"/".join(rng.choices(names, k=rng.randint(1, 5))) for _ in range(600)} | {"", "a", "a//z"})
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    table = scan.rule_table(spark.createDataFrame(list(enumerate(tree.ignore_lines(str(tmp_path)))), "rule_idx long, line string"))
    got = {r["path"]: r["ignored"] for r in scan.ignored_by(df.unionByName(df), table).collect()}
    want = {r["path"]: r["i"] for r in df.select("path", scan.ignored(F.col("path"), scan.compile_rules(lines)).alias("i")).collect()}
    assert got == want and 0 < sum(got.values()) < len(got)


def test_ten_thousand_rules(spark):
    rules = scan.rule_table(spark.range(10_000).selectExpr("id as rule_idx", "if(id % 2 = 0, concat('/r', id % 500, '/f', id), concat('!n', id, '.txt')) as line"))
    paths = spark.range(2_000).selectExpr("concat('r', id % 500, '/f', id) as path").unionByName(spark.range(1, 2_000, 2).selectExpr("concat('x/n', id, '.txt') as path"))
    got = {r["path"]: r["ignored"] for r in scan.ignored_by(paths, rules).collect()}
    assert len(got) == 3_000 and all(got[f"r{i % 500}/f{i}"] == (i % 2 == 0) for i in range(2_000)) and not any(v for p, v in got.items() if p[0] == "x")
    assert scan.ignored_by(paths, rules.where("false")).where("ignored").count() == 0
