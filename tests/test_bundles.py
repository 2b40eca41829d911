"""Kinds, notebooks, imports, entry points, tiers, order and trees of repositories."""

import json

import pytest
from pyspark.sql import functions as F

from tropelens.operators import bundles, repositories

LONG = "x = 1\n"
FILES = {
    "README.md": "Run `python train.py`.\n>>> from pkg.api import go\n",
    "train.py": "import pkg.core as c, os\n",
    "pkg/__init__.py": "from .core import *\n",
    "pkg/core.py": "from . import util\nfrom ..nowhere import z\n",
    "pkg/util.py": "from pkg.deep.end import e\n",
    "pkg/deep/end.py": "import pkg.util\n",  # a cycle
    "pkg/api.py": LONG + "#api",
    "pkg/lonely.py": LONG + "#lonely",
    "pkg/tool.py": 'if __name__ == "__main__":\n    pass\n',
    "scripts/go.sh": "cd sub && python inner/job.py\npython -m pkg.mod\n",
    "sub/inner/job.py": LONG + "#job",
    "pkg/mod.py": LONG + "#mod",
    "third_party/lib.py": "import pkg.lonely\n",
    "tests/test_core.py": "import pkg.lonely\n#t",
    "prompts/ask.txt": "Say why.",
    "conf/model.yaml": "a: 1",
    "copy.py": LONG + "#api",  # the same text as pkg/api.py, and an earlier path
    "min.py": "y" * 1000,  # generated
    "data.csv": "1,2",
    "pkg/README.md": "sub readme",
    "empty.py": " \n",
}


def rows(spark, files=FILES):
    return spark.createDataFrame([("r", p, t) for p, t in files.items()] + [(None, "a.py", "x"), ("r", None, "x"), ("s", "a.py", None)], "repo string, path string, text string")


def test_tiers(spark):
    files = rows(spark)
    known = bundles.facts(files)
    assert {(r["a"], r["b"]) for r in bundles.import_edges(known).collect()} == {
        ("train.py", "pkg/core.py"), ("pkg/__init__.py", "pkg/core.py"), ("pkg/core.py", "pkg/util.py"), ("pkg/core.py", "pkg/__init__.py"),
        ("pkg/util.py", "pkg/deep/end.py"), ("pkg/deep/end.py", "pkg/util.py"), ("third_party/lib.py", "pkg/lonely.py"), ("tests/test_core.py", "pkg/lonely.py"),
    }
    out = {r["path"]: r for r in bundles.ordered(bundles.tiers(known, bundles.readmes_of(files))).collect()}
    got = {p: (r["tier"], r["reason"], r["dist"]) for p, r in out.items()}
    assert got == {
        "train.py": (0, "invoked from README/scripts", 0),
        "sub/inner/job.py": (0, "invoked from README/scripts", 0),
        "pkg/mod.py": (0, "invoked from README/scripts", 0),
        "pkg/tool.py": (0, "has __main__/CLI", 0),
        "scripts/go.sh": (0, "run script", None),
        "prompts/ask.txt": (1, "prompt template", None),
        "pkg/core.py": (1, "imported by entry point (depth 1)", 1),
        "pkg/util.py": (1, "imported by entry point (depth 2)", 2),
        "pkg/__init__.py": (1, "imported by entry point (depth 2)", 2),
        "pkg/deep/end.py": (1, "imported by entry point (depth 3)", 3),
        "copy.py": (2, "other code", None),
        "pkg/lonely.py": (2, "other code", None),
        "conf/model.yaml": (3, "config", None),
        "pkg/README.md": (3, "doc", None),
        "tests/test_core.py": (4, "test", None),
        "third_party/lib.py": (5, "vendored", None),
    }
    order = sorted(out, key=lambda p: out[p]["place"])
    assert order[:3] == ["train.py", "pkg/mod.py", "sub/inner/job.py"] and order[-1] == "third_party/lib.py"
    focus = spark.createDataFrame([("r", "pkg/deep"), ("r", "pk"), ("q", "x")], "repo string, focus string")
    first = bundles.ordered(bundles.tiers(known, bundles.readmes_of(files)), focus).where("place = 1").first()
    assert first["path"] == "pkg/deep/end.py"  # a folder, not a prefix


def test_readme_example_is_a_start(spark):
    files = rows(spark, {p: t for p, t in FILES.items() if p != "copy.py"} | {"pkg/api.py": "import pkg.lonely\n"})
    got = {r["path"]: (r["tier"], r["reason"], r["dist"]) for r in bundles.tiers(bundles.facts(files), bundles.readmes_of(files)).collect()}
    assert got["pkg/api.py"] == (1, "imported in README example", 1) and got["pkg/lonely.py"] == (1, "imported by entry point (depth 2)", 2)


def test_long_chain_and_no_files(spark):
    chain = {"run.py": "import m0\n"} | {f"m{k}.py": f"import m{k + 1}\n" for k in range(14)}
    files = rows(spark, chain)
    got = {r["path"]: r["dist"] for r in bundles.tiers(bundles.facts(files), bundles.readmes_of(files)).collect()}
    assert got == {"run.py": 0} | {f"m{k}.py": k + 1 for k in range(14)}
    none = files.limit(0)
    assert bundles.ordered(bundles.tiers(bundles.facts(none), bundles.readmes_of(none))).count() == 0


@pytest.mark.parametrize(
    ("path", "kind"),
    [("a/Makefile", "shell"), ("x.ipynb", "notebook"), ("a.sh", "shell"), ("A.PY", "code"), ("lib.min.js", None), ("a.j2", "prompt"), ("my_prompts/a.md", "prompt"), ("a.md", None), ("ds_config.json", "config"), ("data.json", None), ("readme.md", None), ("d/README", "doc"), ("requirements.txt", "config"), ("x", None), (".py", None)],
)
def test_kinds(spark, path, kind):
    assert spark.createDataFrame([(path,)], "p string").select(bundles.bundle_kind(F.col("p"))).first()[0] == kind


def test_texts(spark):
    new = json.dumps({"cells": [{"cell_type": "code", "source": ["import a\n", "b"], "outputs": [1]}, {"cell_type": "markdown", "source": "x\ny\n"}, {"cell_type": "code", "source": " \n"}]})
    old = json.dumps({"worksheets": [{"cells": [{"cell_type": "code", "input": ["c = 1"]}]}]})
    table = spark.createDataFrame([(1, new), (2, old), (3, "not json"), (4, None)], "id int, t string")
    got = {r["id"]: r["n"] for r in table.select("id", bundles.notebook_text(F.col("t")).alias("n")).collect()}
    assert got[1] == "# %%\nimport a\nb\n\n# %% [markdown]\n# x\n# y" and got[2] == "# %%\nc = 1" and not got[3] and got[4] is None
    code = "class A(B):\n    def f(self, x):\n        pass\n\nasync def g(): pass\n"
    out = spark.createDataFrame([("a.py", code), ("a.rs", "pub fn f(x: i32) -> i32 {\n  x\n}\n")], "p string, t string").select(bundles.outline(F.col("p"), F.col("t"))).collect()
    assert [x.strip() for x in out[0][0].split("\n") if x] == ["class A(B):", "def f(self, x)", "async def g()"]
    assert out[1][0] == "pub fn f(x: i32) -> i32"


def test_tree(spark):
    rows = [("r", "a.py", 0, "F"), ("r", "d/e/f.py", 5, None), ("r", "d/b.py", 2, "O")] + [("r", f"v/{k:02d}.py", 5, "-") for k in range(13)]
    table = spark.createDataFrame(rows, "repo string, path string, tier int, status string")
    want = "[F] a.py\nd/\n  [O] b.py\n  e/\n    [-] f.py (vendored)\nv/\n  [-] (13 files not shown, vendored)"
    assert bundles.tree(table).first()["tree"] == want
    assert bundles.tree(table, 10).first()["tree"] == want[:10] + "\n... [file tree truncated]"


def test_settled_needs_a_shared_folder_on_clusters():
    class Conf:
        def get(self, *_):
            return None

    class Jsc:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

    class Context:
        master, _jsc = "spark://host:7077", Jsc()

    class Session:
        conf, sparkContext = Conf(), Context()

    class Frame:
        sparkSession = Session()

    with pytest.raises(RuntimeError):
        repositories.settled(Frame())


def test_copies_count_in_queries(spark, tmp_path):
    """Documents 4510 apart have the same head, so equal texts make equal files: the queries' SQL keeps both."""
    import duckdb

    from tropelens.plans import bundle_queries  # noqa: F401
    from tropelens.plans.base import QUERIES, SQL

    docs = spark.createDataFrame([(i, "One line. Another.", "s") for i in (5, 4515, 6, 17)], "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("import_edges", "bundle_tiers", "bundle_trees"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.sql(SQL[name])
        assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall())), name


def test_import_edges_are_made_once_without_a_shuffle(spark):
    """Files that bear and import several names of one another, folders with dots, repeated rows: against plain loops."""
    rows = [("r", "a/b/c.py", ["c", "b.c", "a.b.c", "x"]), ("r", "a.b/c.py", ["b.c", "a.b.c"]), ("r", "x/c.py", ["b.c", "c", "x.c"]), ("r", "x.py", ["c"]), ("r", "x.py", ["x.c", "b.c"]), ("r", "z/__init__.py", ["c", "z"]), ("s", "c.py", ["c", "x"]), ("s", "run.sh", [])]
    rows += [("h", f"d{k}/m{k % 3}.py", [f"m{j % 3}" for j in range(4)] + [f"d{j}.m{j % 3}" for j in range(0, 40, 7)]) for k in range(40)]
    known = spark.createDataFrame(rows, "repo string, path string, imports array<string>")

    def names(path):
        parts = path.removesuffix(".py").removesuffix("/__init__").split("/")
        return {".".join(parts[i:]) for i in range(len(parts))} if path.endswith(".py") else set()

    want = {(r, a, b) for r, a, wanted in rows for s, b, _ in rows if r == s and a != b and names(b) & set(wanted)}
    edges = bundles.import_edges(known)
    got = [tuple(x) for x in edges.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = edges._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Initial Plan") if "Initial Plan" in plan else 0 :]
    assert "Exchange" not in plan[: plan.index("Join")]
