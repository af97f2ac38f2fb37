"""Dependencies from package manifests. Input: files (repo, file, text); output: (repo, language, manifest, name, version, scope).

Line formats share one shape: a running section, taken from the last header at or above a line, decides what the line means. Windows
run within one file, a bounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PYTHON_FILES = ("pyproject.toml", "requirements.txt", "setup.py", "setup.cfg", "Pipfile")
DEV_FILES = ("requirements-dev.txt", "requirements-dev.in", "dev-requirements.txt")
JAVA_FILES = ("pom.xml", "build.gradle", "build.gradle.kts")
#: Manifests of a language that are read in place of one another: the first that a repository has.
PRIMARY = {"python": ("pyproject.toml", "requirements.txt", "setup.py"), "java": JAVA_FILES, "javascript": ("package.json",), "typescript": ("package.json",), "go": ("go.mod",), "rust": ("Cargo.toml",)}
#: Files that count as manifests in a report.
CANDIDATES = ("package.json", "tsconfig.json", *PYTHON_FILES, "go.mod", "Cargo.toml", *JAVA_FILES)
#: Categories of JavaScript packages that are tools, by name pattern; all others are runtime.
DEV_TOOLS = r"^(?:@types/|eslint|prettier|jest|vitest|mocha|webpack|rollup|vite$|typescript$|babel|@babel/|husky|lint-staged|ts-node|nodemon)"


def language(files: DataFrame) -> DataFrame:
    """(repo, language): by the manifests present, in a fixed order of precedence."""
    s = files.groupBy("repo").agg(F.collect_set("file").alias("f"))
    has = lambda *names: F.arrays_overlap("f", F.array(*[F.lit(n) for n in names]))
    return s.select("repo", F.when(has("package.json") & has("tsconfig.json"), "typescript").when(has("package.json"), "javascript").when(has(*PYTHON_FILES), "python").when(has("go.mod"), "go").when(has("Cargo.toml"), "rust").when(has(*JAVA_FILES), "java").otherwise("unknown").alias("language"))


def spec(text: Column) -> tuple[Column, Column]:
    """(name, version) of a requirement: extras go, the first word counts, comparison signs go from the version."""
    one = F.regexp_extract(F.regexp_replace(F.trim(text), r"\[[^\]]*\]", ""), r"^(\S+)", 1)
    name = F.regexp_extract(one, r"^([A-Za-z0-9_.\-]+)", 1)
    version = F.regexp_replace(F.regexp_extract(one, r"^[A-Za-z0-9_.\-]+(.*)$", 1), r"^[=~<>!]+", "")
    return name, F.when(version != "", version)


def _lines(files: DataFrame, *names: str) -> DataFrame:
    return files.where(F.col("file").isin(*names)).select("repo", "file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"\t", " ")))


def _above(flag: Column) -> Column:
    return F.last(flag, ignorenulls=True).over(Window.partitionBy("repo", "file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))


def _out(df: DataFrame, name: Column, version: Column, scope: Column) -> DataFrame:
    return df.select("repo", F.col("file").alias("manifest"), F.col("n").cast("long").alias("n"), name.alias("name"), version.alias("version"), scope.alias("scope")).where("name <> ''")


def package_json(files: DataFrame) -> DataFrame:
    """Dependencies and devDependencies; versions that are no strings are null, and bad JSON gives nothing."""
    f = files.where("file = 'package.json'")
    parts = [f.select("repo", "file", F.lit(s).alias("scope"), F.posexplode(F.map_entries(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,variant>"))).alias("n", "e")) for k, s in (("dependencies", "runtime"), ("devDependencies", "dev"))]
    e = parts[0].unionByName(parts[1])
    e = e.withColumn("n", F.col("n") + F.when(F.col("scope") == "dev", 100_000).otherwise(0))
    text = F.when(F.schema_of_variant("e.value") == "STRING", F.try_variant_get("e.value", "$", "string"))
    return _out(e, F.col("e.key"), text, F.col("scope"))


def requirements(files: DataFrame) -> DataFrame:
    t = _lines(files, "requirements.txt", *DEV_FILES).where((F.col("line") != "") & ~F.col("line").rlike("^[#-]"))
    return _out(t, *spec(F.regexp_replace("line", r"\s+#.*$", "")), F.when(F.col("file") == "requirements.txt", "runtime").otherwise("dev"))


def pyproject(files: DataFrame) -> DataFrame:
    """Sections and multi-line arrays. An array on one line opens the section's list but adds nothing itself."""
    t = _lines(files, "pyproject.toml").where(~F.col("line").rlike("^#"))
    head = F.when(F.col("line").rlike(r"^\["), F.regexp_extract("line", r"^\[+([^\]]+)\]+", 1))
    t = t.withColumn("section", F.coalesce(_above(head), F.lit("")))
    opened = F.when(F.col("line").rlike(r"^\["), F.lit("")).when(F.col("line").rlike(r"^[A-Za-z0-9_.\-\"]+\s*=\s*\["), F.regexp_extract("line", r"^\"?([A-Za-z0-9_.\-]+)", 1)).when(F.col("line").rlike(r"^\]"), F.lit(""))
    t = t.withColumn("key", F.coalesce(_above(opened), F.lit("")))
    listed = ((F.col("section") == "project") & (F.col("key") == "dependencies")) | (F.col("section").isin("project.optional-dependencies", "dependency-groups") & (F.col("key") != ""))
    dev = F.col("section").rlike(r"^(project\.optional-dependencies|dependency-groups|tool\.poetry\.(group\..*|dev-dependencies))")
    scope = F.when(dev, "dev").otherwise("runtime")
    item = t.where(listed & F.col("line").rlike("^[\"']"))
    a = _out(item, *spec(F.regexp_extract("line", "^[\"']([^\"']*)[\"']", 1)), scope)
    row = t.where(F.col("section").rlike(r"^tool\.poetry\.(dependencies|dev-dependencies|group\..*\.dependencies)$") & F.col("line").rlike(r"^[A-Za-z0-9_\-]+\s*="))
    name, version = _toml("line")
    return a.union(_out(row, name, version, scope).where("name <> 'python'"))


def _toml(c: str) -> tuple[Column, Column]:
    """name = "1.0" or name = { version = "1.0" }; dotted keys give no name, ``*`` no version."""
    name = F.regexp_extract(c, r"^\"?([A-Za-z0-9_\-]+)\"?\s*=", 1)
    v = F.coalesce(F.nullif(F.regexp_extract(c, r"=\s*\"([^\"]*)\"\s*(?:#.*)?$", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"version\s*=\s*\"([^\"]*)\"", 1), F.lit("")))
    return name, F.when(v != "*", F.regexp_replace(v, r"^[=~<>!^]+", ""))


def go_mod(files: DataFrame) -> DataFrame:
    t = _lines(files, "go.mod")
    block = F.when(F.col("line").rlike(r"^require\s*\("), F.lit(True)).when(F.col("line").startswith(")"), F.lit(False))
    t = t.withColumn("inside", F.coalesce(_above(block), F.lit(False))).where(~F.col("line").rlike(r"^(//|require\s*\()"))
    t = t.withColumn("spec", F.when(F.col("line").rlike(r"^require\s+\S+\s+v"), F.regexp_replace("line", r"^require\s+", "")).when(F.col("inside"), F.col("line")))
    return _out(t, F.regexp_extract("spec", r"^(\S+)\s+v", 1), F.regexp_extract("spec", r"^\S+\s+(v\S+)", 1), F.lit("runtime"))


def cargo(files: DataFrame) -> DataFrame:
    t = _lines(files, "Cargo.toml")
    t = t.withColumn("section", _above(F.when(F.col("line").rlike(r"^\["), F.regexp_extract("line", r"^\[+([^\]]+)\]+", 1))))
    t = t.where(F.col("section").isin("dependencies", "dev-dependencies"))
    return _out(t, *_toml("line"), F.when(F.col("section") == "dependencies", "runtime").otherwise("dev"))


def pom(files: DataFrame) -> DataFrame:
    """The first dependencies block; test scope is dev, and versions that are properties are dropped."""
    f = files.where("file = 'pom.xml'").withColumn("block", F.regexp_extract("text", r"(?s)<dependencies>(.*?)</dependencies>", 1))
    e = f.select("repo", "file", F.posexplode(F.regexp_extract_all("block", F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("n", "d"))
    tag = lambda k: F.trim(F.regexp_extract("d", rf"(?s)<{k}>(.*?)</{k}>", 1))
    name = F.when((tag("groupId") != "") & (tag("artifactId") != ""), F.concat(tag("groupId"), F.lit(":"), tag("artifactId")))
    return _out(e, name, F.when((tag("version") != "") & ~F.contains(tag("version"), F.lit("${")), tag("version")), F.when(tag("scope") == "test", "dev").otherwise("runtime"))


def gradle(files: DataFrame) -> DataFrame:
    """Five configurations; tests are not told apart, and what is no group:artifact is left out."""
    found = F.regexp_extract_all("text", F.lit(r"(?:implementation|api|compileOnly|runtimeOnly|testImplementation)[\s(]*[\"']([^\"']+)[\"']"), 1)
    e = files.where(F.col("file").isin("build.gradle", "build.gradle.kts")).select("repo", "file", F.posexplode(found).alias("n", "d"))
    p = F.split("d", ":", 3)
    e = e.where((F.size(p) > 1) & (F.get(p, 0) != "") & (F.get(p, 1) != ""))
    return _out(e, F.concat_ws(":", F.get(p, 0), F.get(p, 1)), F.get(p, 2), F.lit("runtime"))


_READERS = {"typescript": (package_json,), "javascript": (package_json,), "python": (pyproject, requirements), "go": (go_mod,), "rust": (cargo,), "java": (pom, gradle)}


def primary(files: DataFrame) -> DataFrame:
    """(repo, language, manifest): the manifest that is read for the repository's language; null if there is none."""
    has = files.groupBy("repo").agg(F.collect_set("file").alias("f_"))
    first = F.lit(None).cast("string")
    for lang, names in PRIMARY.items():
        for n in reversed(names):
            first = F.when((F.col("language") == lang) & F.array_contains("f_", n), n).otherwise(first)
    return language(files).join(has, "repo").select("repo", "language", first.alias("manifest"))


def scan(files: DataFrame) -> DataFrame:
    """(repo, language, manifest, name, version, scope): entries of the primary manifest, then of extra development requirements.

    The first entry of a name within a scope wins.
    """
    lang, out = primary(files).withColumnRenamed("manifest", "p_"), None
    for names, readers in ((("typescript", "javascript"), (package_json,)), *[((k,), v) for k, v in _READERS.items() if k not in ("typescript", "javascript")]):
        for read in readers:
            part = read(files).join(lang.where(F.col("language").isin(*names)), "repo")
            out = part if out is None else out.unionByName(part)
    extra = F.array_position(F.array(*[F.lit(f) for f in DEV_FILES]), F.col("manifest"))
    out = out.withColumn("o", extra).where((F.col("manifest") == F.col("p_")) | (F.col("o") > 0))
    first = Window.partitionBy("repo", "scope", "name").orderBy("o", "n")
    return out.withColumn("r", F.row_number().over(first)).where("r = 1").select("repo", "language", "manifest", "name", "version", "scope")


def report(files: DataFrame) -> DataFrame:
    """(repo, language, manifest, n_manifests, n_dependencies, n_dev) of every repository, with or without entries."""
    held = files.groupBy("repo").agg(F.count_distinct(F.when(F.col("file").isin(*CANDIDATES), F.col("file"))).alias("n_manifests"))
    n = scan(files).groupBy("repo").agg(F.count_if(F.col("scope") == "runtime").alias("n_dependencies"), F.count_if(F.col("scope") == "dev").alias("n_dev"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return primary(files).join(held, "repo").join(n, "repo", "left").select("repo", "language", "manifest", "n_manifests", zero("n_dependencies"), zero("n_dev"))


def classify(deps: DataFrame) -> DataFrame:
    """Entries with a category and whether they are included: runtime ones are, tools and dev dependencies are not."""
    tool = F.col("language").isin("javascript", "typescript") & F.col("name").rlike(DEV_TOOLS)
    kind = F.when((F.col("scope") == "dev") | tool, "devtool").otherwise("runtime")
    return deps.select("repo", "name", "version", kind.alias("category"), (kind == "runtime").alias("included"))
