"""Fixed values of the analysis: names, patterns and word lists, stated as they are."""

from __future__ import annotations

# Heads of subscripts whose arguments are types.
TYPING_FORMS = frozenset("""
Union Optional Annotated Callable List Dict Set FrozenSet Tuple Type DefaultDict OrderedDict Counter Deque ChainMap Sequence
MutableSequence Mapping MutableMapping MutableSet AbstractSet Iterable Iterator Collection Container Generator AsyncIterable
AsyncIterator AsyncGenerator Awaitable Coroutine ClassVar Final Generic Protocol TypeGuard Required NotRequired ReadOnly
Concatenate Unpack ContextManager AsyncContextManager Pattern Match IO list dict set frozenset tuple type
""".split())
# Calls that look names up at run time.
DYNAMIC_CALLS = frozenset("getattr setattr globals locals eval exec __import__ import_module".split())
DYNAMIC_ATTRIBUTES = frozenset("import_module __import__".split())
# Settings whose dotted strings a framework imports.
SETTING_LISTS = frozenset("MIDDLEWARE INSTALLED_APPS AUTHENTICATION_BACKENDS".split())
# Decorators (last part) of functions that a framework calls.
ENTRY_DECORATORS = """
route get post put delete patch head options task shared_task command group fixture websocket on_event middleware
exception_handler errorhandler before_request after_request teardown_request context_processor template_filter template_global
listens_for receiver hookimpl hookspec periodic_task subscriber listener
""".split()
PYDANTIC_DECORATORS = "validator field_validator model_validator computed_field field_serializer model_serializer".split()
NOT_APP_DECORATORS = "fixture hookimpl hookspec".split()
PROPERTY_DECORATORS = "property cached_property setter deleter".split()
WALKED_PROPERTIES = "property cached_property".split()
NEUTRAL_DECORATORS = """
property cached_property staticmethod classmethod setter deleter abstractmethod abstractproperty abstractclassmethod
abstractstaticmethod
""".split()
FIELD_DECORATORS = "dataclass define".split()
FIELD_NAMES = "attr.s attr.define attr.frozen attr.mutable attrs.define attrs.frozen attrs.mutable".split()
# Bases.
ENUM_BASES = "Enum IntEnum StrEnum Flag IntFlag".split()
VISITOR_BASES = "NodeVisitor NodeTransformer".split()
NAMED_FIELD_BASES = "BaseModel DeclarativeBase".split()
DECLARATIVE_BASES = """
BaseModel BaseSettings DeclarativeBase DeclarativeBaseNoMeta Model SQLModel Schema Serializer ModelSerializer Form ModelForm
TypedDict NamedTuple Protocol Struct Document
""".split()
TRIVIAL_BASES = "object type".split()
TYPING_BASES = ["Generic"]
# Files.
ENTRY_PATTERNS = """
**/__main__.py **/wsgi.py **/asgi.py **/manage.py setup.py **/docs/conf.py noxfile.py fabfile.py tasks.py **/gunicorn.conf.py
**/alembic/env.py scripts/**/*.py bin/**/*.py
""".split()
DJANGO_PATTERNS = "**/settings.py **/admin.py **/apps.py **/urls.py **/migrations/*.py".split()
EXCLUDES = ".git .git/** .venv .venv/** venv venv/** **/__pycache__ **/__pycache__/** build build/** dist dist/**".split()
TEST_PATTERNS = """
tests tests/** **/tests/** /test /test/** tests.py **/tests.py test_*.py **/test_*.py *_test.py **/*_test.py conftest.py
**/conftest.py
""".split()
MANIFESTS = "requirements.txt requirements-dev.txt pyproject.toml Pipfile setup.py setup.cfg".split()
MANIFEST_SKIP_DIRS = ".git .hg .svn .venv venv __pycache__ build dist site-packages node_modules".split()
EXAMPLE_DIRS = "example examples sample samples demo demos tutorial tutorials benchmark benchmarks".split()
APP_FILES = "__main__.py wsgi.py asgi.py manage.py gunicorn.conf.py".split()
TOOLING_FILES = "setup.py conf.py noxfile.py fabfile.py tasks.py".split()
SIDE_DIRS = "docs doc examples example tutorial tutorials samples sample demo demos benchmarks scripts bin tools".split()
NOT_IMPORT_ROOTS = "tests test testing docs doc examples node_modules build dist venv site-packages".split()
BOOT_FILES = "manage.py wsgi.py asgi.py".split()
META_FILES = "models.py admin.py forms.py serializers.py".split()
META_DIRS = "models admin forms serializers".split()
URL_SYMBOLS = "urlpatterns handler400 handler403 handler404 handler500".split()
ALEMBIC_NAMES = "upgrade downgrade revision down_revision branch_labels depends_on".split()
# Packages.
RUNTIME_ONLY = """
gunicorn uvicorn hypercorn daphne waitress gevent eventlet psycopg psycopg2 psycopg2-binary mysqlclient pymysql asyncpg redis
hiredis whitenoise python-multipart uvloop httptools email-validator
""".split()
TOOLING = """
black flake8 mypy pylint ruff isort pytest coverage tox nox pre-commit setuptools wheel pip pip-tools twine build bandit
pyright autopep8 yapf sphinx mkdocs
""".split()
TOOLING_PREFIXES = "pytest- flake8- types- mypy- pylint- sphinx- mkdocs- django-stubs".split()
TOOLING_SUFFIXES = ["-stubs"]
DEV_EXTRAS = "dev test tests docs doc lint".split()
CANONICAL = {
    "pil": "pillow",
    "yaml": "pyyaml",
    "sklearn": "scikit-learn",
    "cv2": "opencv-python",
    "opencv-python-headless": "opencv-python",
    "bs4": "beautifulsoup4",
    "openssl": "pyopenssl",
}
IMPORT_ALIAS = {"psycopg2-binary": "psycopg2", "pyjwt": "jwt", "python-dotenv": "dotenv", "python-jose": "jose"}
# Rules and the kind of thing each names.
RULES = {
    "UNUSED_IMPORT": "import",
    "UNUSED_FUNCTION": "function",
    "UNUSED_CLASS": "class",
    "UNUSED_VARIABLE": "variable",
    "UNREACHABLE_CODE": "statement",
    "ORPHAN_FUNCTION": "function",
    "POSSIBLY_UNUSED_MODULE": "module",
    "WILDCARD_IMPORT": "import",
    "UNUSED_DEPENDENCY": "package",
    "DUPLICATE_CODE": "function",
    "UNUSED_IGNORE": "ignore",
    "IGNORE_WITHOUT_REASON": "ignore",
}
KIND_RULES = {"import": "UNUSED_IMPORT", "function": "UNUSED_FUNCTION", "class": "UNUSED_CLASS", "variable": "UNUSED_VARIABLE"}
CAPPED_RULES = "UNUSED_FUNCTION UNUSED_CLASS UNUSED_VARIABLE UNUSED_IMPORT ORPHAN_FUNCTION DUPLICATE_CODE".split()
# Evidence sentences by their reason code.
REASONS = {
    "no_references": "No references found.",
    "no_decorators": "No decorators.",
    "not_exported": "Not exported.",
    "not_entry": "Not an entry point.",
    "no_dynamic_refs": "No dynamic references detected.",
    "unresolved_attr_call": "An unresolved attribute call uses this name.",
    "no_entry_reaches": "No entry point reaches this function.",
    "no_scan_entry": "This scan found no entry point, so this may be a library whose callers are outside the scan.",
    "module_cap": "This file has no incoming imports, so this score follows the module.",
    "framework_convention": "Framework convention. This name is loaded by the framework without a local reference.",
    "public_name": "Public name. Callers outside this project may still load it.",
    "may_override_external": "May override a method of an external base.",
    "no_incoming_imports": "No incoming imports detected.",
    "unrecognized_decorator": "Decorated, but not a recognized framework entry.",
    "dynamic_usage": "Dynamic usage detected. Static analysis cannot prove this symbol is unused.",
    "settings_sweep": "This module is read with getattr or dir(), so this name may be loaded by that loop.",
    "namespace_import": "A top-level import uses this package's namespace, so the dependency cannot be proved unused.",
    "wildcard_import": "Wildcard import prevents reliable analysis.",
    "no_dist_metadata": "Distribution metadata is unavailable, so the package cannot be proved unused.",
    "lambda_only": "Only referenced from a lambda this scan did not prove is called.",
    "string_reference": "Named by a dotted string. The final attribute was not found on that module.",
    "string_names_package": "A string in the source names this package, as settings and plugin lists do.",
    "import_probe": "This import sits in a try that catches ImportError, so it may be an availability check.",
    "side_effect_import": "Import may run the submodule for its side effects.",
    "package_init": "Possible public re-export.",
    "parse_error_nearby": "A file failed to parse, so it may use this symbol.",
    "alembic_name": "Alembic loads this name when the migration runs.",
    "unreachable": "Control flow terminates before this statement.",
    "runtime_package": "This package is often started without an import.",
    "tooling_package": "This package is a tool or plugin that runs without being imported.",
    "unused_ignore": "This ignore directive suppressed nothing.",
    "ignore_without_reason": "This ignore directive has no reason.",
}
