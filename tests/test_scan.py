"""Whole scans of small projects; all of them run as one scan, each under its own project id."""

import pytest

from cinderbark.plans.config import Allow, Config
from cinderbark.plans.scan import Scan

MAIN = "if __name__ == '__main__':\n    print({})\n"
BODY = "    {a} = v\n    {a} += 1\n    {a} += 2\n    {a} += 3\n    return {a}\n"

#: project: (files, findings that must be there, symbols that must not)
CASES = {
    "golden": ({"app.py": "import os\n\ndef helper():\n    return 1\n\n" + MAIN.format("helper()")}, {("UNUSED_IMPORT", "os", 100)}, {"helper"}),
    "local": ({"mod.py": "def total(d):\n    r = sum(d)\n    spare = 1\n    return r\n" + MAIN.format("total([])")}, {("UNUSED_VARIABLE", "spare", 100)}, {"r", "total"}),
    "bases": ({"mod.py": "LIMIT = 5\nclass A:\n    pass\nclass B(A):\n    pass\n"}, {("UNUSED_VARIABLE", "LIMIT", 60), ("UNUSED_CLASS", "B", 60)}, {"A"}),
    "nested": ({"mod.py": "def outer():\n    def inner():\n        return 1\n    return 2\n" + MAIN.format("outer()")}, {("UNUSED_FUNCTION", "inner", 100)}, {"outer"}),
    "decorated": ({"app.py": "def deco(f):\n    return f\n@deco\ndef go():\n    return 1\n", "main.py": "import app\n" + MAIN.format("app")}, {("UNUSED_FUNCTION", "go", 75)}, {"deco"}),
    "modules": (
        {"pkg/__init__.py": "from . import a\na\n", "pkg/a.py": "from . import b\nb\n", "pkg/b.py": "", "pkg/c.py": "", "main.py": "import pkg\n" + MAIN.format("pkg"), "wsgi.py": "app = None\n"},
        {("POSSIBLY_UNUSED_MODULE", "pkg/c.py", 82)},
        {"pkg/a.py", "pkg/b.py", "wsgi.py", "main.py"},
    ),
    "src": ({"src/app/__init__.py": "from . import kept\nkept\n", "src/app/kept.py": "", "src/app/old.py": "", "main.py": "import app\n" + MAIN.format("app")}, {("POSSIBLY_UNUSED_MODULE", "src/app/old.py", 82)}, {"src/app/kept.py"}),
    "src_prefix": (
        {"src/acc/__init__.py": "", "src/acc/cache.py": "def drop(t):\n    return t\ndef keep(t):\n    return t\n", "src/main.py": "from src.acc.cache import drop\nif __name__ == '__main__':\n    drop(1)\n"},
        {("UNUSED_FUNCTION", "keep", 96)},
        {"drop", "src/acc/cache.py"},
    ),
    "tests_out": ({"shown.py": "def shown():\n    return 1\n", "test_x.py": "def lost():\n    return 1\n", "tests/t.py": "def gone():\n    return 1\n"}, {("UNUSED_FUNCTION", "shown", 60)}, {"lost", "gone"}),
    "reexport": ({"pkg/__init__.py": "from .core import Widget as Widget\n", "pkg/core.py": "class Widget:\n    pass\n", "main.py": "import pkg\n" + MAIN.format("pkg")}, set(), {"Widget"}),
    "unused_import_keeps_nothing": (
        {"pkg/__init__.py": "", "pkg/api.py": "def dead():\n    return 1\n", "pkg/o.py": "from .api import dead\n", "main.py": "import pkg.o\n" + MAIN.format("pkg.o")},
        {("UNUSED_FUNCTION", "dead", 96), ("UNUSED_IMPORT", "dead", 100)},
        set(),
    ),
    "module_attribute": ({"pkg/__init__.py": "", "pkg/types.py": "class Extra:\n    pass\n", "pkg/core.py": "from . import types\ndef show() -> types.Extra:\n    return types.Extra()\n", "main.py": "from pkg.core import show\n" + MAIN.format("show()")}, set(), {"Extra", "show"}),
    "entries": ({"setup.py": "import helper\nhelper.run()\n", "helper.py": "def run():\n    return 1\n", "docs/conf.py": "project = 'x'\nimport theme\ntheme.load()\n", "theme.py": "def load():\n    return 1\n"}, set(), {"run", "load", "project", "setup.py", "docs/conf.py"}),
    "module_cap": ({"main.py": MAIN.format(1), "lone.py": "def helper():\n    return 1\n    v = 2\n"}, {("UNUSED_FUNCTION", "helper", 82), ("UNREACHABLE_CODE", "v = 2", 100)}, set()),
    "dynamic_module": ({"dyn.py": "import importlib\nimportlib.import_module('missing')\n", "lone.py": "def helper():\n    return 1\n", "main.py": "import dyn\n" + MAIN.format("dyn")}, {("UNUSED_FUNCTION", "helper", 60), ("POSSIBLY_UNUSED_MODULE", "lone.py", 60)}, set()),
    "duplicates": ({"pkg/__init__.py": "", "pkg/a.py": "def a(v):\n" + BODY.format(a="x"), "pkg/b.py": "def b(v):\n" + BODY.format(a="y"), "main.py": "import pkg.a\nimport pkg.b\n" + MAIN.format("pkg.a, pkg.b")}, {("DUPLICATE_CODE", "b", 80)}, set()),
    "alembic": ({"alembic/versions/001.py": "revision = '1'\ndef upgrade():\n    pass\n", "main.py": MAIN.format(1)}, {("UNUSED_FUNCTION", "upgrade", 70)}, set()),
    "lambda_returned": ({"app.py": "def sel(i):\n    def t(x):\n        return x\n    def unused():\n        return 0\n    return lambda x: t(x)\nif __name__ == '__main__':\n    sel([])\n"}, {("UNUSED_FUNCTION", "unused", 100)}, {"t", "sel"}),
    "orphan_chain": ({"main.py": "def a():\n    b()\ndef b():\n    pass\n    return c()\ndef c():\n    x = 1\n    return x\n" + MAIN.format(1)}, {("UNUSED_FUNCTION", "a", 96), ("ORPHAN_FUNCTION", "b", 80), ("ORPHAN_FUNCTION", "c", 80)}, set()),
    "methods": (
        {"m.py": "class P:\n    def run(self):\n        return self.step()\n    def step(self):\n        return 0\nclass Q(P):\n    def step(self):\n        return 1\n    def idle(self):\n        return 2\n    def __len__(self):\n        return size()\ndef size():\n    return 3\nif __name__ == '__main__':\n    Q().run()\n"},
        {("UNUSED_FUNCTION", "idle", 96)},
        {"run", "step", "size", "__len__"},
    ),
    "unknown_receiver": ({"m.py": "class A:\n    def go(self):\n        return 1\n    def one(self):\n        return 1\nclass B:\n    def go(self):\n        return 2\nA, B\ndef f(x):\n    x.go()\n    x.one()\nif __name__ == '__main__':\n    f(A())\n    B()\n"}, {("ORPHAN_FUNCTION", "go", 60)}, {"one"}),
    "external_base": ({"m.py": "import lib\nclass A(lib.Base):\n    def hook(self):\n        return 1\n    opt = 1\nif __name__ == '__main__':\n    A()\n"}, {("UNUSED_FUNCTION", "hook", 60), ("UNUSED_VARIABLE", "opt", 60)}, set()),
    "fields": ({"m.py": "from dataclasses import dataclass\nfrom enum import Enum\n@dataclass\nclass D:\n    f1: int = 1\nclass E(Enum):\n    f2 = 1\nclass C:\n    f3 = 1\nif __name__ == '__main__':\n    print(D(), E, C())\n"}, {("UNUSED_VARIABLE", "f3", 96)}, {"f1", "f2"}),
    "wildcard": ({"a.py": "def shown():\n    return 1\ndef _hidden():\n    return 2\n", "main.py": "from a import *\nif __name__ == '__main__':\n    shown()\n"}, {("WILDCARD_IMPORT", "a.*", 60), ("UNUSED_FUNCTION", "_hidden", 96)}, {"shown"}),
    "probe": ({"main.py": "try:\n    import fast\nexcept ImportError:\n    pass\nimport a.b\n" + MAIN.format(1)}, {("UNUSED_IMPORT", "fast", 70), ("UNUSED_IMPORT", "a", 70)}, set()),
    "run_time": ({"main.py": "def on_a():\n    return 1\nk = 'a'\n" + "if __name__ == '__main__':\n    print(getattr(k, 'on_' + k))\n"}, {("UNUSED_FUNCTION", "on_a", 70)}, set()),
    "broken": ({"good.py": "def used():\n    return 1\ndef other():\n    return 2\n", "main.py": "import good\n" + MAIN.format("good"), "bad.py": "def (\n  other\n"}, {("UNUSED_FUNCTION", "used", 96), ("UNUSED_FUNCTION", "other", 70)}, set()),
    "rebound": ({"c.py": "def f():\n    return 1\n", "main.py": "from c import f\nf = f\n" + MAIN.format(1)}, set(), set()),
    "ignored": ({"main.py": "import a  # cinderbark: ignore\nimport b  # cinderbark: ignore[unused-class]\n# cinderbark: ignore[unused-import]\nimport c\n" + MAIN.format(1)}, {("UNUSED_IMPORT", "b", 100), ("UNUSED_IGNORE", "unused_class", 100)}, {"a", "c"}),
    "allowed": ({"main.py": "import skip_me\ndef legacy_x():\n    return 1\n" + MAIN.format(1)}, {("UNUSED_IMPORT", "skip_me", 100)}, {"legacy_x"}),
    "entry_decorator": ({"app.py": "import web\n@web.route('/')\ndef page():\n    return helper()\ndef helper():\n    return 1\n"}, set(), {"page", "helper", "app.py"}),
    "settings": ({"manage.py": "import os\nos.environ['DJANGO_SETTINGS_MODULE'] = 'site.conf'\n", "site/__init__.py": "", "site/conf.py": "TIMEOUT = 1\n", "site/apps.py": "from django.apps import AppConfig\nclass Site(AppConfig):\n    pass\n"}, {("UNUSED_VARIABLE", "TIMEOUT", 60), ("UNUSED_CLASS", "Site", 60)}, set()),
    "setting_string": ({"manage.py": "import conf\n", "conf.py": "MIDDLEWARE = ['mid.One', 'mid.Gone']\n", "mid.py": "class One:\n    pass\nclass Two:\n    pass\n"}, {("UNUSED_CLASS", "Two", 82)}, {"One"}),
    "result_type": ({"m.py": "class R:\n    def go(self):\n        return 1\ndef make() -> R:\n    return R()\nif __name__ == '__main__':\n    make().go()\n    x = make()\n    x.go()\n"}, set(), {"go", "make"}),
    "scripts": ({"pkg/__init__.py": "", "pkg/cli.py": "def main():\n    return 1\n"}, set(), {"main", "pkg/cli.py"}),
}
MANIFESTS = {
    ("scripts", "pyproject.toml"): "[project]\ndependencies = ['requests', 'pyyaml', 'gunicorn', 'lib-x', 'psycopg2-binary']\n[project.scripts]\nrun = 'pkg.cli:main'\n[project.optional-dependencies]\ndev = ['black', 'tool-y']\n",
    ("modules", "requirements.txt"): "# none\nFoo_Bar==1\npkg  # ours\n-r other.txt\n",
    ("modules", "examples/requirements.txt"): "never\n",
    ("src", "setup.cfg"): "[options]\ninstall_requires =\n    cfgdep>=1\n",
    ("src", "setup.py"): "setup(install_requires=['pydep'])\n",
    ("src", "Pipfile"): "[packages]\npipdep = '*'\n[dev-packages]\ndevdep = '*'\n",
    ("golden", "pyproject.toml"): "[broken\n",
}


@pytest.fixture(scope="module")
def scan(spark):
    sources = [(p, path, text) for p, (files, *_) in CASES.items() for path, text in files.items()]
    config = Config(report_unused_ignores=True, allow=(Allow("legacy_*", "unused-function"), Allow("skip_*", "unused-class")))
    manifests = spark.createDataFrame([(p, path, t) for (p, path), t in MANIFESTS.items()], "project_id string, path string, source string")
    dists = spark.createDataFrame([("requests", "requests", None), ("foo_bar", "foo-bar", None)], "top string, dist string, file string")
    return Scan(spark.createDataFrame(sources, "project_id string, path string, source string"), config, manifests, dists)


@pytest.fixture(scope="module")
def found(scan):
    out = {}
    for r in scan.report(min_confidence=0).collect():
        out.setdefault(r.project_id, []).append(r)
    return out


@pytest.mark.parametrize("project", list(CASES))
def test_findings(found, project):
    _, there, gone = CASES[project]
    rows = {(r.rule, r.symbol, r.confidence) for r in found.get(project, [])}
    assert there <= rows
    assert not gone & {s for _, s, _ in rows}


def test_dependencies(found):
    scores = {(r.project_id, r.symbol): (r.confidence, r.line) for rows in found.values() for r in rows if r.rule == "UNUSED_DEPENDENCY"}
    assert scores["scripts", "requests"] == (95, 2) and scores["scripts", "gunicorn"][0] == 70 and scores["scripts", "lib-x"][0] == 70
    assert ("scripts", "black") not in scores and ("scripts", "tool-y") not in scores
    assert scores["modules", "foo-bar"] == (95, 2) and ("modules", "pkg") not in scores and ("modules", "never") not in scores
    assert {s for p, s in scores if p == "src"} == {"cfgdep", "pydep", "pipdep"}


def test_ids_and_reasons(found):
    (os_,) = [r for r in found["golden"] if r.rule == "UNUSED_IMPORT"]
    assert (os_.id, os_.fingerprint, os_.kind, os_.reasons) == ("VYFXA7GLCT", "UNUSED_IMPORT:app.py:os", "import", ["no_references"])
    ids = [(p, r.id) for p, rows in found.items() for r in rows]
    assert len(ids) == len(set(ids))


def test_errors(scan):
    (e,) = scan.errors.collect()
    assert (e.project_id, e.path, e.line) == ("broken", "bad.py", 1)
    assert [r.path for r in scan.declared.filter("error IS NOT NULL").collect()] == ["pyproject.toml"]


def test_baselines_and_reports(spark, scan):
    from cinderbark.operators import present
    from cinderbark.sources import reports

    f = scan.report(min_confidence=0).filter("project_id = 'golden'")
    known = spark.createDataFrame([("UNUSED_IMPORT:app.py:os",)], "fingerprint string")
    assert scan.report(known).filter("project_id = 'golden'").count() == 0
    assert scan.report(known, "all").filter("project_id = 'golden'").first().baselined
    assert reports.concise(f, True).first().text == "app.py:1:8: UNUSED_IMPORT Import 'os' is never used. [100]"
    assert reports.github(f).first().text == "::error file=app.py,line=1,title=UNUSED_IMPORT::Import 'os' is never used."
    assert reports.plain(f).first().text == "UNUSED_IMPORT\nFile: app.py\nLine: 1\nImport: os\nConfidence: 100%\nEvidence: No references found."
    assert reports.jsonl(f).first().text == '{"id":"VYFXA7GLCT","fingerprint":"UNUSED_IMPORT:app.py:os","rule":"UNUSED_IMPORT","path":"app.py","line":1,"column":8,"symbol":"os","status":"DEAD","confidence":100,"message":"Import \'os\' is never used.","reasons":["no_references"],"evidence":[],"fix":{"applicability":"safe"}}'
    assert '"startColumn":8' in reports.sarif(f).first().text
    assert present.located(f, "VYFX").first().symbol == "os" and present.located(f, "app.py:1").first().symbol == "os"
    with pytest.raises(Exception, match="unknown id"):
        present.located(f, "nope").collect()
    assert present.mentions(f, scan.sources).first().mentions == 0
    _, census = present.present(scan.report(min_confidence=0), max_findings=3)
    assert census.first().total == scan.report(min_confidence=0).count()


def test_fixes(spark, scan):
    from cinderbark.operators import fixes

    fixed = {(r.project_id, r.path): r for r in fixes.fixes(scan.report(min_confidence=0), scan.sources).collect()}
    assert fixed["golden", "app.py"].new_source.startswith("\ndef helper") and "-import os" in fixed["golden", "app.py"].diff
    assert "spare" not in fixed["local", "mod.py"].new_source
    dirty = spark.createDataFrame([("golden", "app.py", 1)], "project_id string, path string, line int")
    kept = {(r.project_id, r.path): r for r in fixes.fixes(scan.report(min_confidence=0), scan.sources, dirty).collect()}
    assert kept["golden", "app.py"].applied == []
    again = Scan(fixes.applied_sources(scan.sources, fixes.fixes(scan.report(min_confidence=0), scan.sources)), Config())
    assert again.errors.count() == 1
    live = spark.createDataFrame([("golden", "app.py", "helper")], "project_id string, path string, qualname string")
    assert fixes.evaluate(scan.report(min_confidence=0), live).first().wrong == 0
    ends = {(r.project_id, r.fingerprint): (r.end_line, r.end_column) for r in fixes.ends(scan.report(min_confidence=0), scan.sources).collect()}
    assert ends["golden", "UNUSED_IMPORT:app.py:os"] == (1, 10)
