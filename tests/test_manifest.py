from codeloom.sources import manifest

FILES = [
    ("js", "package.json", '{"dependencies": {"react": "^18.0.0", "eslint": "8", "odd": 5}, "devDependencies": {"jest": "29"}}'),
    ("bad", "package.json", "{nope"),
    ("py", "pyproject.toml", '[project]\nname = "x"\ndependencies = [\n  "numpy>=1.2",\n  "pandas[all]==2.0 ; x",\n]\n[project.optional-dependencies]\ntest = [\n "pytest"\n]\n[tool.poetry.dependencies]\npython = "^3"\nhttpx = { version = "^0.2", extras = ["x"] }\n[tool.poetry.group.dev.dependencies]\nblack = "*"\n'),
    ("py1", "pyproject.toml", '[project]\ndependencies = ["requests"]\n'),
    ("req", "requirements.txt", "# c\nflask==2.0\n-r x\n\nnumpy\nflask==3\n"),
    ("req", "requirements-dev.txt", "pytest~=7\n"),
    ("go", "go.mod", "module x\nrequire a/b v1.0\nrequire (\n\tc/d v2.0 // indirect\n)\n"),
    ("rs", "Cargo.toml", '[dependencies]\nserde = "1"\nany = "*"\ntokio = { version = "1.2" }\nx.y = "1"\n[dev-dependencies]\nprop = "2"\n'),
    ("mv", "pom.xml", "<dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency><dependency><groupId>h</groupId><artifactId>b</artifactId><version>1</version><scope>test</scope></dependency></dependencies>"),
    ("gr", "build.gradle", "implementation 'a:b:1'\ntestImplementation(\"c:d:2\")\nimplementation(project(':x'))\napi 'alone'\n"),
    ("py", "requirements.txt", "ignored==1\n"),
    ("py", "requirements-dev.in", "tox\n"),
    ("mv", "build.gradle", "implementation 'not:read:1'\n"),
    ("none", "README.md", "text"),
]


def test_all_formats(spark):
    f = spark.createDataFrame(FILES, "repo string, file string, text string")
    got: dict = {}
    for r in manifest.scan(f).collect():
        got.setdefault(r["repo"], set()).add((r["name"], r["version"], r["scope"]))
    assert got == {
        "js": {("react", "^18.0.0", "runtime"), ("eslint", "8", "runtime"), ("odd", None, "runtime"), ("jest", "29", "dev")},
        "py": {("numpy", "1.2", "runtime"), ("pandas", "2.0", "runtime"), ("pytest", None, "dev"), ("httpx", "0.2", "runtime"), ("black", None, "dev"), ("tox", None, "dev")},
        "req": {("flask", "2.0", "runtime"), ("numpy", None, "runtime"), ("pytest", "7", "dev")},
        "go": {("a/b", "v1.0", "runtime"), ("c/d", "v2.0", "runtime")},
        "rs": {("serde", "1", "runtime"), ("any", None, "runtime"), ("tokio", "1.2", "runtime"), ("prop", "2", "dev")},
        "mv": {("g:a", None, "runtime"), ("h:b", "1", "dev")},
        "gr": {("a:b", "1", "runtime"), ("c:d", "2", "runtime")},
    }
    assert dict(map(tuple, manifest.language(f).collect()))["py"] == "python"
    c = {r["name"]: r["included"] for r in manifest.classify(manifest.scan(f)).where("repo = 'js'").collect()}
    assert c == {"react": True, "eslint": False, "odd": True, "jest": False}
    rep = {r["repo"]: (r["language"], r["manifest"], r["n_manifests"], r["n_dependencies"], r["n_dev"]) for r in manifest.report(f).collect()}
    assert rep["py"] == ("python", "pyproject.toml", 2, 3, 3) and rep["none"] == ("unknown", None, 0, 0, 0) and rep["mv"] == ("java", "pom.xml", 2, 1, 1) and rep["bad"][3:] == (0, 0)
