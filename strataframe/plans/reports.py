"""Reports as text: log, graph, summary, status."""

from __future__ import annotations

import functools
import importlib.metadata
import platform
import sys
import time
from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions.sizes import format_bytes
from ..operators import history
from ..sources.store import Store
from .differ import Diff


def log_contents(store: Store, head: str) -> dict:
    """head, ancestors (digest -> parents), specs, order (latest first), branch_heads (digest -> names)."""
    parents, times = store.parents(), store.times()
    commits = store.commits()
    order = history.log_order(parents, times, head) if head else []
    names: dict[str, list[str]] = {}
    for name, digest in sorted(store.heads().items()):
        names.setdefault(digest, []).append(name)
    return {
        "head": head,
        "ancestors": history.ancestors(parents, head) if head else {},
        "specs": {d: {k: commits[d][k] for k in ("commit_time", "message", "user", "email")} for d in order},
        "order": order,
        "branch_heads": names,
    }


def graph(contents: dict, show_time: bool = False, show_user: bool = False) -> str:
    """The history as lanes of text: ``*`` at a commit, one lane for each line of descent still open."""
    lanes: list[str] = []
    out: list[str] = []
    for digest in contents["order"]:
        if digest not in lanes:
            lanes.append(digest)
        at = lanes.index(digest)
        marks = " ".join("*" if i == at else "|" for i in range(len(lanes)))
        spec = contents["specs"][digest]
        names = contents["branch_heads"].get(digest)
        parts = [digest, f"({', '.join(names)})" if names else "", f"({time.strftime('%d%b%Y %H:%M:%S', time.gmtime(spec['commit_time']))})" if show_time else "", f"({spec['user']})" if show_user else "", ": " + spec["message"]]
        out.append(f"{marks} {' '.join(p for p in parts[:-1] if p)} {parts[-1]}")
        parents = contents["ancestors"][digest]
        fresh = [p for p in parents if p not in lanes]
        before = len(lanes)
        lanes[at : at + 1] = fresh
        if len(parents) > 1 and len(lanes) > before:
            out.append(" ".join("|" for _ in range(at + 1)) + "\\" + " |" * (len(lanes) - at - 2))
        elif len(lanes) < before and lanes:
            out.append(" ".join("|" for _ in range(at)) + ("/" if at else "|"))
    return "\n".join(out)


def log(store: Store, head: str, return_contents: bool = False, show_time: bool = False, show_user: bool = False):
    contents = log_contents(store, head)
    if return_contents:
        return contents
    text = graph(contents, show_time, show_user)
    print(text)
    return None


def summary(store: Store, commit: str) -> str:
    """Where the repository is, how large, its commit, and each column's counts and schema."""
    known = store.schemas()
    refs = store.refs(commit)
    counts = {r["col"]: (r["samples"], r["records"]) for r in refs.where("kind <> 's'").groupBy("col", "sample_key").agg(F.count("*").alias("n")).groupBy("col").agg(F.count("*").alias("samples"), F.sum("n").alias("records")).collect()}
    schemas = refs.where("kind = 's'").orderBy("col").collect()
    spec = store.commits().get(commit)
    lines = ["Repository", f"  path: {store.files.root}", f"  size: {format_bytes(store.files.size())}", "Commit", f"  digest: {commit or 'none'}"]
    if spec:
        lines += [f"  time: {time.asctime(time.gmtime(spec['commit_time']))}", f"  message: {spec['message']}", f"  by: {spec['user']} <{spec['email']}>"]
    lines.append(f"Columns: {len(schemas)}")
    for r in schemas:
        samples, records = counts.get(r["col"], (0, 0))
        s = known[r["digest"]]
        lines += [f"  {r['col']}", f"    samples: {samples}", *([f"    subsamples: {records}"] if s.layout == "nested" else []), f"    type: {s.kind}, {s.layout}, {'variable' if s.variable else 'fixed'} shape"]
        if s.kind == "ndarray":
            lines.append(f"    values: {s.dtype} {s.shape}")
        lines.append(f"    storage: {s.storage} {s.storage_options}")
    return "\n".join(lines)


def status_text(branch: str, diff: Diff) -> str:
    """Of each kind of change the schemas, and samples counted by column."""
    rows = diff.changes.groupBy("change", "kind", "col").agg(F.count("*").alias("n")).orderBy("col").collect()
    lines = [f"Branch: {branch}"]
    for change in ("added", "deleted", "mutated"):
        own = [r for r in rows if r["change"] == change]
        schemas = [r for r in own if r["kind"] == "s"]
        samples = [r for r in own if r["kind"] != "s"]
        lines += [f"{change.capitalize()}", f"  schemas: {len(schemas)}", *[f"    {r['col']}" for r in schemas], f"  samples: {sum(r['n'] for r in samples)}", *[f"    {r['col']}: {r['n']}" for r in samples]]
    return "\n".join(lines)


def details(store: Store, table: str, line_limit: int = 100) -> list[str]:
    """The first lines of a table, for a look at it."""
    return [str(r) for r in {"objects": store.objects().drop("data", "text"), "refs": store.all_refs(), "commits": store.commits_table(), "heads": store.heads_table(), "schemas": store.schemas_table()}[table].limit(line_limit).collect()]


#: Packages the library needs, and those that only some of its parts use.
NEEDED, OPTIONAL = ["pyspark", "py4j", "numpy", "pandas", "pyarrow"], ["torch", "tensorflow", "duckdb", "tokenizers", "tiktoken", "xxhash"]


def _versions(names: list[str]) -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    for n in names:
        try:
            out[n] = importlib.metadata.version(n)
        except importlib.metadata.PackageNotFoundError:
            out[n] = None
    return out


def ecosystem() -> dict[str, dict[str, str | None]]:
    """host, packages and optional packages, each a name with its version (None where a package is absent)."""
    host = platform.uname()
    return {
        "host": {"python": platform.python_version(), "bits": str(64 if sys.maxsize > 1 << 32 else 32), "system": host.system, "release": host.release, "machine": host.machine, "byteorder": sys.byteorder},
        "packages": _versions(NEEDED),
        "optional": _versions(OPTIONAL),
    }


def told_as_damage(check: Callable) -> Callable:
    """Of a check of stored data: faults it names are raised as they are, any other error as a RuntimeError that says what was read."""

    @functools.wraps(check)
    def run(*args, **kwargs):
        try:
            return check(*args, **kwargs)
        except RuntimeError:
            raise
        except Exception as e:
            at = e.__traceback__
            while at.tb_next:
                at = at.tb_next
            names = at.tb_frame.f_code.co_varnames[: at.tb_frame.f_code.co_argcount]
            given = {n: repr(at.tb_frame.f_locals.get(n))[:200] for n in names}
            raise RuntimeError(f"stored data that {check.__name__.strip('_')} reads can't be parsed: {type(e).__name__}: {e}; in {at.tb_frame.f_code.co_name} with {given}") from e

    return run
