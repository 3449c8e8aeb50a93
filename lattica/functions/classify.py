"""Rules that classify a file by its path, as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a route, an entry point, a layer.
ROUTE_FILES = [
    "page.tsx", "page.ts", "page.jsx", "page.js", "layout.tsx", "layout.ts", "loading.tsx", "loading.ts", "error.tsx", "error.ts",
    "not-found.tsx", "not-found.ts", "route.ts", "route.tsx", "template.tsx", "template.ts", "default.tsx", "default.ts", "middleware.ts", "middleware.js",
]
TEST_FILE = r"\.(test|spec)\.(js|jsx|ts|tsx)$"
STORY_FILE = r"\.stories\.(js|jsx|ts|tsx|mjs|cjs)$"
CONFIG_FILE = r"\.config\.(js|ts|cjs|mjs)$"
LAYERS = [
    ("Data", r"(^|/)(models?|db|database|repositories|schema|prisma|migrations)(/|$)"),
    ("Infrastructure", r"(^|/)(config|infra|infrastructure|middleware)(/|$)"),
    ("Services", r"(^|/)(services|api|clients)(/|$)"),
    ("Presentation", r"(^|/)(components|pages|app|views|screens)(/|$)"),
    ("Application", r"(^|/)(hooks|store|state|context|reducers|lib|core)(/|$)"),
]
LAYER_ORDER = ["Presentation", "Application", "Services", "Data", "Infrastructure", "Other"]
SERVICE_PATH = r"(?i)/(services|api|clients)/"
ROOT_MODULE = "(root)"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The part before the last slash; empty without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def under_or_equal(path: Column, root: Column | str) -> Column:
    root = F.lit(root) if isinstance(root, str) else root
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def relative(path: Column, root: str) -> Column:
    """The path without the root before it; unchanged elsewhere."""
    return F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path) if root else path


def is_internal(path: Column, root: str) -> Column:
    return ~path.contains("/node_modules/") & under_or_equal(path, root)


def module_name(rel: Column) -> Column:
    """The first directory below the root, a leading src left out."""
    parts = F.filter(F.split(rel, "/"), lambda x: x != "")
    base = F.when(F.get(parts, F.lit(0)) == "src", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(F.size(base) > 1, F.get(base, F.lit(0))).otherwise(ROOT_MODULE)


def is_route(rel: Column) -> Column:
    pages = F.startswith(rel, F.lit("pages/")) | rel.contains("/pages/")
    app = F.startswith(rel, F.lit("app/")) | rel.contains("/app/")
    return pages | (app & basename(rel).isin(ROUTE_FILES))


def is_entry_by_path(rel: Column, package_dirs: list[str] | None = None) -> Column:
    """Entry points that a path alone tells; `package_dirs` are the package roots, relative ("" is the root)."""
    name = basename(rel)
    config = dirname(rel).isin(package_dirs if package_dirs is not None else [""]) & name.rlike(CONFIG_FILE)
    return is_route(rel) | name.isin("middleware.ts", "middleware.js") | name.rlike(TEST_FILE) | rel.contains("__tests__/") | name.rlike(STORY_FILE) | config


def file_kind(path: Column, entry: Column, component: Column, klass: Column) -> Column:
    return F.when(entry, "entry").when(component, "component").when(klass, "class").when(path.rlike(SERVICE_PATH), "service").otherwise("utility")


def layer(path: Column, kind: Column) -> Column:
    p = F.lower(path)
    rules = [(name, p.rlike(rx) | (kind == "component") if name == "Presentation" else p.rlike(rx)) for name, rx in LAYERS]
    return reduce(lambda case, r: case.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0])).otherwise("Other")


def clamp_score(x: Column) -> Column:
    """Rounded half up, between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(x + 0.5))).cast("long")


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 50, "warn").otherwise("bad")


def bar(value: Column, most: Column, width: int = 10) -> Column:
    filled = F.when(most <= 0, 0).otherwise(F.least(F.lit(width), F.greatest(F.lit(0), F.floor(value / most * width + 0.5)))).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def node_size(incoming: Column) -> Column:
    return F.least(F.lit(40), F.greatest(F.lit(10), 10 + 3 * incoming))
