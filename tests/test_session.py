import ast
from pathlib import Path

import pytest
from tallyspring import session

ROOT = Path(session.__file__).parent


def test_tables_are_written_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_folder(spark) == folder
    df = session.materialize(spark.range(10).selectExpr("id", "id * 2 AS twice"), "numbers")
    assert df.count() == 10 and df.columns == ["id", "twice"]
    assert all(f.startswith(f"file:{folder}") or f.startswith(f"file://{folder}") for f in df.inputFiles())
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_workers_find_the_package(spark):
    session.ship(spark)
    session.ship(spark)

    def where(it):
        from tallyspring.operators import records

        for b in it:
            yield b.assign(reason=[records.parse(x, ",")[0] for x in b["line"]])

    got = spark.createDataFrame([("x",), ("2024-01-01,a,b,1,2",)], "line string").mapInPandas(where, "line string, reason string").collect()
    assert {r.line: r.reason for r in got} == {"x": "columns", "2024-01-01,a,b,1,2": None}


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield node.module


def test_nothing_outside_imports_the_optional_subpackage():
    for p in ROOT.rglob("*.py"):
        if p.parent.name != "llm":
            assert not [m for m in imports(p) if "llm" in m], p


def test_written_tables_go_with_release(spark):
    df = session.materialize(spark.range(3), "gone")
    where = [Path(f.removeprefix("file:").replace("///", "/")) for f in df.inputFiles()]
    assert all(p.exists() for p in where)
    session.release(spark)
    assert not any(p.exists() for p in where)


def test_no_folder_of_one_machine_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
