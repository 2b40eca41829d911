"""What of a repository matters first: kinds of files, import edges, entry points, tiers and reading order.

files has a row per file (repo, path, text), readmes one per repository (repo, text). Rows without repo or path are no files;
a null text is empty. Texts are read once, by column expressions; everything after works on names and paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tropelens.functions.text import let
from tropelens.operators.repositories import reachable, settled

# Extensions, names and folders by which files are classified, and expressions of entry points.
CODE = ".py .pyx .js .jsx .ts .tsx .mjs .java .kt .scala .c .cc .cpp .cu .h .hpp .go .rs .rb .php .pl .pm .r .jl .lua .m .swift .hs .lisp .asd .clj .ml .mli .el .sql .proto .cs .fs .ex .exs .erl .dart .groovy .pro .prolog".split()
SHELL = ".sh .bash .zsh .slurm .sbatch".split()
CONFIG = ".yaml .yml .toml .cfg .ini .gin .conf .jsonnet".split()
PROMPT = ".prompt .j2 .jinja .jinja2 .tmpl".split()
SHELL_NAMES = "makefile dockerfile snakefile justfile".split()
CONFIG_NAMES = "requirements.txt environment.yml setup.py pyproject.toml".split()
CONFIG_JSON = r"(?i)(config|hparam|hyperparam|args|param|setting|ds_|deepspeed|accelerate)"
VENDOR = (
    "third_party third-party thirdparty 3rdparty external externals extern vendor vendored deps transformers fairseq apex megatron megatron-lm allennlp peft trl vllm "
    "deepspeed lm_eval lm-evaluation-harness torchtune nltk spacy pytorch_pretrained_bert pytorch_transformers detectron2 mmcv timm open_clip sentence_transformers opennmt "
    "onmt tensor2tensor flash_attn accelerate datasets_lib llama_factory llamafactory verl openrlhf lavis fastchat"
).split()
VENDOR_HEADER = (
    r"(?i)Copyright[^\n]{0,80}(HuggingFace|Google (AI|LLC|Inc)|The TensorFlow Authors|Facebook|Meta Platforms|NVIDIA|Microsoft Corporation|OpenAI|Allen Institute|"
    r"The Google AI Language Team|EleutherAI|DeepMind)"
)
ENTRY_NAME = (
    r"(?i)^(train|main|run|eval|evaluate|infer|inference|predict|finetune|fine_tune|pretrain|test_model|experiment|experiments|pipeline|app|demo|generate|benchmark|score|"
    r"analysis|analyze)([_\-].*)?$"
)
TEST_PATH = r"(^|/)(tests?|testing|unittests?)(/|$)|(^|/)test_[^/]+\.py$|_test\.py$"
SUPPORT_PATH = (
    r"(?i)(^|/)(docker|docs?|ci|\.circleci|\.devcontainer|website|site)(/|$)|(^|/)(install|setup|build|release|stamp|sync|lint|format|run_ruff|publish|deploy|bump)[^/]*$"
)
MAIN_GUARD = r"""(?m)^if\s+__name__\s*==\s*['"]__main__['"]"""
CLI = r"\b(argparse|ArgumentParser|import click|@click\.|typer\.|@hydra\.main|fire\.Fire|absl\.app|tf\.app\.run|HfArgumentParser)\b"
RUN_FILE = r"""(?m)(?:^|[\s;&|(`"'])((?:[\w./\-]+/)?[\w\-]+\.py)\b"""
RUN_MODULE = r"\bpython[\d.]*\s+(?:-\w+\s+)*-m\s+([\w.]+)"
IMPORT = r"(?m)^\s*(?:from\s+(\.*[\w.]*)\s+import\s+([\w*, ()]+)|import\s+([\w., ]+))"
SHOWN_IMPORT = r"(?m)^\s*(?:>>>\s*)?(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"
#: Reasons of the first tier, the strongest evidence first.
ENTRY_REASONS = ["invoked from README/scripts", "entry-point name", "has __main__/CLI", "run script"]
OUTLINE_PYTHON = r"(?m)^\s*(class\s+\w+[^:]*:|(async\s+)?def\s+\w+\s*\([^)]*\)?)"
OUTLINE_OTHER = (
    r"(?m)^\s*(?:(?:public|private|protected|static|export|async|pub|fn|func|function|def|class|struct|interface|trait|impl|module|object|type|template|virtual|inline)\b"
    r"[^;{=\n]{0,160})"
)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def bundle_kind(path: Column) -> Column:
    """shell, notebook, code, prompt, config or doc; null for what doesn't belong in a bundle."""
    name = F.lower(base_name(path))
    ext = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    folders = F.slice(F.split(F.lower(path), "/"), 1, F.size(F.split(path, "/")) - 1)
    in_prompts = F.exists(folders, lambda p: p.contains("prompt"))
    nested_readme = name.isin("readme.md", "readme.rst", "readme.txt", "readme") & (F.size(folders) > 0)
    return (
        F.when(name.isin(*SHELL_NAMES), "shell")
        .when(ext == ".ipynb", "notebook")
        .when(ext.isin(*SHELL), "shell")
        .when(ext.isin(*CODE), F.when(~name.rlike(r"\.(min|bundle)\.js$"), "code"))
        .when(ext.isin(*PROMPT) | (ext.isin(".txt", ".md") & in_prompts), "prompt")
        .when(ext.isin(*CONFIG) | ((ext == ".json") & base_name(path).rlike(CONFIG_JSON)), "config")
        .when(nested_readme, "doc")
        .when(name.isin(*CONFIG_NAMES), "config")
    )


def is_vendored(path: Column, kind: Column, text: Column) -> Column:
    folders = F.slice(F.split(F.lower(path), "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(folders, F.array(*map(F.lit, VENDOR))) | (kind.isin("code", "notebook") & F.substring(text, 1, 3000).rlike(VENDOR_HEADER))


def is_generated(text: Column) -> Column:
    """Lines of over 300 characters on average."""
    lines = F.regexp_count(F.regexp_replace(text, r"\n\z", ""), F.lit("\n")) + 1
    return F.length(text) / lines > 300


def is_support(path: Column) -> Column:
    """Tests, packaging, documentation."""
    return path.rlike(TEST_PATH) | path.rlike(SUPPORT_PATH)


def notebook_text(source: Column) -> Column:
    """Code and Markdown cells of a notebook (of either format) as text; null where it isn't one."""
    cell = "array<struct<cell_type: string, source: string, input: string>>"
    book = F.from_json(source, f"struct<cells: {cell}, worksheets: array<struct<cells: {cell}>>>")
    cells = F.coalesce(book["cells"], F.flatten(F.transform(book["worksheets"], lambda w: w["cells"])), F.array().cast(cell))

    def body(c: Column) -> Column:
        raw = F.coalesce(c["source"], c["input"], F.lit(""))  # one string, or a list of lines as JSON text
        return F.coalesce(F.when(raw.startswith("["), F.array_join(F.from_json(raw, "array<string>"), "")), raw)

    def shown(c: Column) -> Column:
        text = F.regexp_replace(body(c), r"\n\z", "")
        return F.when(c["cell_type"] == "markdown", F.concat(F.lit("# %% [markdown]\n# "), F.replace(text, F.lit("\n"), F.lit("\n# ")))).when(c["cell_type"] == "code", F.concat(F.lit("# %%\n"), body(c)))

    kept = F.filter(cells, lambda c: F.btrim(body(c), F.lit(" \t\r\n")) != "")
    return F.when(book.isNotNull(), F.array_join(F.array_compact(F.transform(kept, shown)), "\n\n"))


def outline(path: Column, text: Column) -> Column:
    """Signatures, a line each, found by expressions: classes and functions of Python, declarations of other languages."""
    lines = F.when(path.endswith(".py") | path.endswith(".ipynb"), F.regexp_extract_all(text, F.lit(OUTLINE_PYTHON), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(OUTLINE_OTHER), F.lit(0)))
    return F.array_join(F.transform(lines, lambda x: F.substring(F.regexp_replace(x, r"\s+\z", ""), 1, 200)), "\n")


def module_names(path: Column) -> Column:
    """Every dotted name by which a Python file could be imported: its path's suffixes; a package's file stands for it."""
    parts = F.split(F.regexp_replace(path, r"(/__init__)?\.py$", ""), "/")
    parts = F.when(path == "__init__.py", F.array().cast("array<string>")).otherwise(parts)
    return let(parts, lambda p: F.transform(F.filter(F.sequence(F.lit(0), F.size(p)), lambda i: i > 0), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))


def before_as(name: Column) -> Column:
    return F.trim(F.substring_index(F.trim(name), " as ", 1))


def import_targets(path: Column, text: Column) -> Column:
    """Distinct dotted names that a Python text imports, relative ones anchored at its folder; of `from a import b` both a
    and a.b, as b may be a module."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)

    def targets(s: Column) -> Column:
        plain, module, names = (F.regexp_extract(s, IMPORT, k) for k in (3, 1, 2))
        rest = F.ltrim(module, F.lit("."))
        up = F.length(module) - F.length(rest)
        anchor = F.when(up - 1 <= F.size(folders), F.slice(folders, 1, F.greatest(F.size(folders) - (up - 1), F.lit(0)))).otherwise(F.array().cast("array<string>"))
        base = F.when(up > 0, F.array_join(F.concat(anchor, F.when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>"))), ".")).otherwise(rest)
        listed = F.filter(F.transform(F.split(F.btrim(names, F.lit("() ")), ","), before_as), lambda n: ~n.isin("", "*"))
        both = let(base, lambda b: F.concat(F.array(b), F.transform(listed, lambda n: F.when(b == "", n).otherwise(F.concat(b, F.lit("."), n)))))
        return F.when(plain != "", F.transform(F.split(plain, ","), before_as)).otherwise(both)

    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(IMPORT), F.lit(0)), targets))
    return F.filter(F.array_distinct(found), lambda n: n != "")


def all_matches(text: Column, *groups: tuple[str, int]) -> Column:
    return F.array_distinct(F.filter(F.concat(*(F.regexp_extract_all(text, F.lit(rx), F.lit(g)) for rx, g in groups)), lambda x: x != ""))


def facts(files: DataFrame, copies: bool = False) -> DataFrame:
    """Per candidate file, without its text: repo, path, kind, size, vendored, support, cli, imports, runs, modules. Of equal
    texts in a repository the one with the smallest path counts, with `copies` all; generated, empty and unclassified files don't."""
    rows = files.where("repo is not null and path is not null").select("repo", "path", bundle_kind(F.col("path")).alias("kind"), F.coalesce("text", F.lit("")).alias("text")).where("kind is not null")
    rows = rows.withColumn("text", F.when(F.col("kind") == "notebook", notebook_text(F.col("text"))).otherwise(F.col("text")))
    rows = rows.where((F.btrim("text", F.lit(" \t\r\n\f\x0b")) != "") & ~(F.col("kind").isin("code", "notebook") & is_generated(F.col("text"))))
    path, kind, text, name = F.col("path"), F.col("kind"), F.col("text"), base_name(F.col("path"))
    says = kind.isin("shell", "config", "doc") & ~name.startswith(".") & ~is_support(path)
    none = F.array().cast("array<string>")
    rows = rows.select(
        "repo",
        "path",
        "kind",
        F.length(text).alias("size"),
        F.md5(text.cast("binary")).alias("digest"),
        is_vendored(path, kind, text).alias("vendored"),
        is_support(path).alias("support"),
        (kind.isin("code", "notebook") & (text.rlike(MAIN_GUARD) | text.rlike(CLI))).alias("cli"),
        F.when(path.endswith(".py"), import_targets(path, text)).otherwise(none).alias("imports"),
        F.when(says, all_matches(text, (RUN_FILE, 1))).otherwise(none).alias("runs"),
        F.when(says, all_matches(text, (RUN_MODULE, 1))).otherwise(none).alias("modules"),
    )
    rows = settled(rows)  # texts are read once, and later plans don't repeat these expressions
    if copies:
        return rows.drop("digest")
    first = rows.groupBy("repo", "digest").agg(F.min("path").alias("path"))
    return rows.join(first, ["repo", "digest", "path"], "left_semi").drop("digest")


def names_of(known: DataFrame) -> DataFrame:
    """(repo, name, path) of the Python files."""
    return known.where(F.col("path").endswith(".py")).select("repo", F.explode(module_names(F.col("path"))).alias("name"), "path")


def import_edges(known: DataFrame) -> DataFrame:
    """facts -> (repo, a, b): file a imports file b, by any name that b's path ends with.

    Where names are frequent, edges grow with the square of the files: they are made once and streamed, never shuffled. Of
    several names by which a imports b one ends the others, so an edge is made by the shortest of them alone.
    """
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # set: small sides make many edges
    files = known.groupBy("repo", "path").agg(F.array_distinct(F.flatten(F.collect_list("imports"))).alias("imports"))
    named = files.select("repo", F.col("path").alias("a"), "imports", F.explode("imports").alias("name"))
    shorter = F.filter("imports", lambda n: F.col("name").endswith(F.concat(F.lit("."), n)))
    wanted = named.select("repo", "a", "name", shorter.alias("shorter")).repartition(parts, "repo", "name")
    names = names_of(known.select("repo", "path").distinct()).withColumnRenamed("path", "b").repartition(parts, "repo", "name")
    again = F.when(F.size("shorter") > 0, F.arrays_overlap("shorter", module_names(F.col("b")))).otherwise(False)
    return wanted.join(names.hint("merge"), ["repo", "name"]).where((F.col("a") != F.col("b")) & ~again).select("repo", "a", "b")


def invoked(known: DataFrame, readmes: DataFrame) -> DataFrame:
    """(repo, path) of files that a README, script, configuration or nested README runs, by path, by the end of a path (scripts
    change folders first), or as a module."""
    text = F.coalesce("text", F.lit(""))
    shown = readmes.where("repo is not null").select("repo", all_matches(text, (RUN_FILE, 1)).alias("runs"), all_matches(text, (RUN_MODULE, 1)).alias("modules"))
    said = known.where("not vendored").select("repo", "runs", "modules").union(shown)
    refs = said.select("repo", F.explode("runs").alias("ref")).select("repo", F.ltrim("ref", F.lit("./")).alias("ref")).distinct()
    paths = known.select("repo", "path")
    exact = refs.join(paths.withColumnRenamed("path", "ref"), ["repo", "ref"], "left_semi")
    ends = refs.join(exact, ["repo", "ref"], "left_anti").withColumn("base", base_name(F.col("ref")))
    ends = ends.join(paths.withColumn("base", base_name(F.col("path"))), ["repo", "base"]).where(F.col("path").endswith(F.col("ref")))
    modules = said.select("repo", F.explode("modules").alias("name")).distinct().join(names_of(known), ["repo", "name"])
    return reduce(DataFrame.union, [exact.select("repo", F.col("ref").alias("path")), ends.select("repo", "path"), modules.select("repo", "path")]).distinct()


def tiers(known: DataFrame, readmes: DataFrame) -> DataFrame:
    """facts -> (repo, path, kind, size, vendored, tier, reason, dist): 0 entry points, 1 prompts and what entry points and the
    README's examples reach by imports, 2 other code, 3 configuration, 4 tests and packaging, 5 vendored.

    The search goes from files to names and from names to files, so a name that many files import and many files bear costs
    their sum and no pair is made. Vendored files aren't entered. dist counts imports from the nearest start.
    """
    known = settled(known)
    runs = invoked(known, readmes).withColumn("invoked", F.lit(True))
    rows = known.join(runs, ["repo", "path"], "left").withColumn("invoked", F.coalesce("invoked", F.lit(False)))
    stem = F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", "")
    kind, own, source = F.col("kind"), ~F.col("support"), F.col("kind").isin("code", "notebook")
    cases = [
        (F.col("invoked") & own, 0, "invoked from README/scripts"),
        (F.col("vendored"), 5, "vendored"),
        (kind == "shell", 0, "run script"),
        (own & F.col("cli"), 0, "has __main__/CLI"),
        (own & source & stem.rlike(ENTRY_NAME), 0, "entry-point name"),
        (kind == "prompt", 1, "prompt template"),
        (kind.isin("config", "doc"), 3, None),
        (F.col("support"), 4, "test"),
        (F.lit(True), 2, "other code"),
    ]
    verdict = F.coalesce(*(F.when(when, F.struct(F.lit(t).alias("tier"), (kind if why is None else F.lit(why)).alias("reason"))) for when, t, why in cases))
    rows = settled(rows.select("repo", "path", "kind", "size", "vendored", verdict.alias("v")).select("repo", "path", "kind", "size", "vendored", "v.*"))

    def node(what: str, key: str | Column) -> Column:
        return F.struct(F.lit(what).alias("what"), F.col("repo").alias("repo"), (F.col(key) if isinstance(key, str) else key).alias("key"))

    names = names_of(known.where("not vendored"))
    shown = readmes.where("repo is not null").select("repo", F.explode(all_matches(F.coalesce("text", F.lit("")), (SHOWN_IMPORT, 1), (SHOWN_IMPORT, 2))).alias("name"))
    edges = known.select("repo", "path", F.explode("imports").alias("name")).select(node("file", "path").alias("a"), node("name", "name").alias("b"))
    edges = edges.union(names.select(node("name", "name"), node("file", "path"))).union(shown.select(node("readme", F.lit("")), node("name", "name")))
    starts = rows.where((F.col("tier") == 0) & F.col("path").endswith(".py")).select(node("file", "path").alias("node"))
    starts = starts.union(shown.select(node("readme", F.lit(""))).distinct())
    found = reachable(settled(edges.distinct()), starts).where("node.what = 'file'").select("node.repo", F.col("node.key").alias("path"), (F.col("depth") / 2).cast("int").alias("dist"))
    seeds = shown.join(names, ["repo", "name"]).select("repo", "path", F.lit(True).alias("shown")).distinct()
    rows = rows.join(found, ["repo", "path"], "left").join(seeds, ["repo", "path"], "left")
    example = F.col("shown") & F.col("tier").isin(2, 4) & F.col("dist").isNotNull()
    reached = F.col("dist").isNotNull() & (F.col("tier") == 2)
    reason = F.when(example, "imported in README example").when(reached, F.concat(F.lit("imported by entry point (depth "), F.col("dist").cast("string"), F.lit(")"))).otherwise(F.col("reason"))
    return rows.withColumn("reason", reason).withColumn("tier", F.when(example | reached, 1).otherwise(F.col("tier"))).drop("shown")


def ordered(tiered: DataFrame, focus: DataFrame | None = None) -> DataFrame:
    """tiers with `place` from 1 in their repository: linked files and folders first (focus: repo, focus), then by tier, strength of
    the evidence, distance, depth, size and path."""
    depth = F.size(F.split("path", "/")) - 1
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ENTRY_REASONS)), F.col("reason")), F.lit(0))
    inside = F.lit(0)
    if focus is not None:
        tiered = tiered.join(focus.groupBy("repo").agg(F.collect_set("focus").alias("__focus")), "repo", "left")
        inside = F.coalesce(F.exists("__focus", lambda f: (F.col("path") == f) | F.col("path").startswith(F.concat(f, F.lit("/")))), F.lit(False)).cast("int")
    order = [F.desc("__in"), "tier", "__rank", F.coalesce("dist", F.lit(99)), "__depth", "size", "path"]
    rows = tiered.withColumns({"__in": inside, "__rank": rank, "__depth": depth})
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).drop("__in", "__rank", "__depth", "__focus")


def tree(files: DataFrame, most: int = 15_000, fold: int = 12) -> DataFrame:
    """(repo, path, tier, status) -> (repo, tree): a line per folder and file with its status, folders of over `fold` files of
    which none is shown as one line, cut at `most` characters. Folders are put together first, then repositories."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    rows = files.select("repo", folder.alias("d"), base_name(F.col("path")).alias("name"), "tier", F.coalesce("status", F.lit("-")).alias("status"))
    depth = F.when(F.col("d") == "", 0).otherwise(F.size(F.split("d", "/")))
    pad = F.repeat(F.lit("  "), depth)
    line = F.concat(pad, F.lit("["), "status", F.lit("] "), "name", F.when(F.col("tier") == 5, " (vendored)").otherwise(""))
    sums = rows.groupBy("repo", "d").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("status") != "-").alias("some"),
        F.min(F.col("tier") == 5).alias("vendored"),
        F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("lines"),
    )
    head = F.when(F.col("d") != "", F.concat(F.repeat(F.lit("  "), depth - 1), base_name(F.col("d")), F.lit("/\n"))).otherwise("")
    folded = F.concat(pad, F.lit("[-] ("), F.col("n").cast("string"), F.lit(" files not shown"), F.when(F.col("vendored"), ", vendored").otherwise(""), F.lit(")"))
    body = F.when((F.col("n") > fold) & ~F.col("some"), folded).otherwise(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    texts = sums.select("repo", "d", F.substring(F.concat(head, body), 1, most + 1).alias("t"))  # no folder needs more of itself
    whole = texts.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "t"))), lambda x: x["t"]), "\n").alias("tree"))
    return whole.withColumn("tree", F.when(F.length("tree") > most, F.concat(F.substring("tree", 1, most), F.lit("\n... [file tree truncated]"))).otherwise(F.col("tree")))


def readmes_of(files: DataFrame) -> DataFrame:
    """(repo, text): the README at a repository's top, the first by path."""
    top = files.where("repo is not null").where(F.col("path").rlike(r"(?i)^readme(\.[^./]*)?$"))
    return top.groupBy("repo").agg(F.min_by(F.struct("text"), "path")["text"].alias("text"))
