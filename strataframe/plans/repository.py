"""A repository: branches of commits over one store, one writer at a time."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import SparkSession

from .. import __version__
from ..functions import digests
from ..functions.keys import check_name
from ..functions.sizes import format_bytes
from ..functions.versions import can_read
from ..operators import history, integrity
from ..sources.store import FORMAT, LOCK, Store
from . import reports
from .checkout import Checkout, WriterCheckout
from .differ import Diff, compare
from .merger import merge_into


class Repository:
    """``path`` is a folder on any storage that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, self.path)
        if self.initialized and self.store.state().get("format") != FORMAT:
            raise RuntimeError(f"format {self.store.state().get('format')} of {path} is not {FORMAT}")
        if self.initialized and not can_read(self.store.state()["version"]):
            raise RuntimeError(f"{path} was made by version {self.store.state()['version']}, which this one can't read")

    # Life.

    @property
    def initialized(self) -> bool:
        return self.store.files.exists("state.json")

    def _ready(self) -> None:
        if not self.initialized:
            raise RuntimeError(f"{self.path} is no repository; call init")

    def init(self, user_name: str, user_email: str, *, remove_old: bool = False) -> str:
        if self.initialized:
            if not remove_old:
                raise OSError(f"{self.path} is a repository already")
            self.store.files.delete()
            self.store = Store(self.spark, self.path)
        self.store.files.write_json("state.json", {"format": FORMAT, "version": __version__, "user": user_name, "email": user_email, "branch": "master", "seq": 0})
        self.store.set_heads({"master": ""})
        self.store.files.write_json("remotes.json", {})
        return self.path

    @property
    def version(self) -> str:
        self._ready()
        return self.store.state()["version"]

    @property
    def size_nbytes(self) -> int:
        self._ready()
        return self.store.files.size()

    @property
    def size_human(self) -> str:
        return format_bytes(self.size_nbytes)

    @property
    def remote(self):
        from .remotes import Remotes

        self._ready()
        return Remotes(self)

    # The writer's lock.

    @property
    def writer_lock_held(self) -> bool:
        self._ready()
        return self.store.files.exists(LOCK)

    def acquire_lock(self, holder: str) -> str:
        return self.store.lock(holder)

    def release_lock(self, holder: str) -> None:
        self.store.unlock(holder)

    def force_release_writer_lock(self) -> bool:
        self._ready()
        self.store.files.delete(LOCK)
        return True

    # Checkouts.

    def _head(self, branch: str) -> str:
        heads = self.store.heads()
        if branch not in heads:
            raise ValueError(f"no branch {branch!r}")
        return heads[branch]

    def checkout(self, write: bool = False, *, branch: str = "", commit: str = "", verify: bool = False) -> Checkout | WriterCheckout:
        """A commit, else a branch, else the staging area's branch. Only one write checkout can be open.

        ``verify`` works a read checkout's digest out anew from its records, in one pass over them; OSError if it differs.
        """
        self._ready()
        staging = self.store.state()["branch"]
        if not write:
            at = history.expand_digest(list(self.store.commits()), commit) if commit else self._head(branch or staging)
            if verify and at:
                refs = self.store.refs(at)
                if digests.refs_digest(digests.record_hash(refs), refs).first()["refs_digest"] != self.store.commits()[at]["refs_digest"]:
                    raise OSError(f"the records of {at} do not have its digest")
            return Checkout(self.store, at)
        if commit:
            raise ValueError("a write checkout is of a branch")
        holder = self.acquire_lock(uuid.uuid4().hex)
        try:
            branch = branch or staging
            self._head(branch)
            if branch != staging:
                if WriterCheckout(self, staging, holder).diff.status() == "DIRTY":
                    raise ValueError(f"changes are staged on {staging!r}; commit or reset them first")
                self.store.clear_staging()
                self.store.set_state(branch=branch)
            return WriterCheckout(self, branch, holder)
        except BaseException:
            self.release_lock(holder)
            raise

    def clone(self, user_name: str, user_email: str, remote_address: str, *, remove_old: bool = False) -> str:
        """A repository with the remote's history as ``origin`` and its master branch, values left there."""
        self.init(user_name, user_email, remove_old=remove_old)
        self.remote.add("origin", remote_address)
        self.remote.fetch("origin", "master")
        self.store.set_heads(self.store.heads() | {"master": self.store.heads()["origin/master"]})
        return "master"

    # Branches.

    def create_branch(self, name: str, base_commit: str | None = None) -> tuple[str, str]:
        self._ready()
        check_name(name, "branch")
        heads = self.store.heads()
        if name in heads:
            raise ValueError(f"branch {name!r} is there already")
        digest = history.expand_digest(list(self.store.commits()), base_commit) if base_commit else heads[self.store.state()["branch"]]
        if not digest:
            raise RuntimeError("make a commit before a branch")
        self.store.set_heads(heads | {name: digest})
        return name, digest

    def remove_branch(self, name: str, *, force_delete: bool = False) -> tuple[str, str]:
        """Refused: unknown, last or staging branches, a held lock, and unmerged commits unless forced."""
        self._ready()
        heads = self.store.heads()
        if name not in heads:
            raise ValueError(f"no branch {name!r}")
        if len([h for h in heads if "/" not in h]) == 1 and "/" not in name:
            raise PermissionError("the last branch stays")
        if self.writer_lock_held:
            raise PermissionError("a writer holds the lock")
        if name == self.store.state()["branch"]:
            raise PermissionError("the staging area's branch stays")
        parents = self.store.parents()
        if not force_delete and not any(heads[name] in history.ancestors(parents, d) for h, d in heads.items() if h != name):
            raise RuntimeError(f"commits of {name!r} are in no other branch")
        self.store.set_heads({h: d for h, d in heads.items() if h != name})
        return name, heads[name]

    def list_branches(self) -> list[str]:
        self._ready()
        return sorted(self.store.heads())

    # History.

    def log(self, branch: str | None = None, commit: str | None = None, *, return_contents: bool = False, show_time: bool = False, show_user: bool = False):
        self._ready()
        head = history.expand_digest(list(self.store.commits()), commit) if commit else self._head(branch or self.store.state()["branch"])
        return reports.log(self.store, head, return_contents, show_time, show_user)

    def summary(self, *, branch: str = "", commit: str = "") -> str:
        self._ready()
        head = history.expand_digest(list(self.store.commits()), commit) if commit else self._head(branch or self.store.state()["branch"])
        text = reports.summary(self.store, head)
        print(text)
        return text

    def _digest(self, name: str) -> str:
        heads = self.store.heads()
        if name in heads:
            return heads[name]
        if name in self.store.commits():
            return name
        raise ValueError(f"{name!r} is no branch or commit")

    def diff(self, master: str, dev: str) -> Diff:
        """Between branches or full commit digests."""
        self._ready()
        mine = self._digest(master)
        return compare(self.store, mine, self.store.refs(mine), self._digest(dev))

    def merge(self, message: str, master_branch: str, dev_branch: str) -> str:
        self._ready()
        with self.store.locked("merge"):
            return merge_into(self.store, message, master_branch, dev_branch)

    @staticmethod
    def ecosystem() -> dict:
        """Versions of the host, the packages used and the optional ones."""
        return reports.ecosystem()

    # Integrity.

    def verify_repo_integrity(self) -> bool:
        """Branches, commit graph, snapshots, schemas and values; RuntimeError at the first fault."""
        self._ready()
        with self.store.locked("verify"):
            return self._verify()

    @reports.told_as_damage
    def _verify(self) -> bool:
        def none(rows, what: str) -> None:
            if bad := rows.take(3):
                raise RuntimeError(f"{what}: {[tuple(r) for r in bad]}")

        s = self.store
        heads = s.heads()
        if not heads:
            raise RuntimeError("there is no branch")
        if s.state()["branch"] not in heads:
            raise RuntimeError(f"the staging area's branch {s.state()['branch']!r} is gone")
        commits = s.commits_table()
        none(integrity.heads_without_commit(s.heads_table().where("digest <> ''"), commits), "branches without commit")
        none(integrity.parents_missing(commits), "commits without parent")
        if len(found := integrity.roots(commits).take(2)) > 1:
            raise RuntimeError(f"more than one first commit: {[r[0] for r in found]}")
        if not s.commits():
            return True
        refs = s.all_refs()
        found = {r["commit"]: r["refs_digest"] for r in digests.refs_digest(digests.record_hash(refs), refs, ["commit"]).collect()}
        for digest, c in s.commits().items():
            spec = {k: c[k] for k in ("commit_time", "message", "user", "email")}
            own = found.get(digest, digests.EMPTY_REFS)
            if own != c["refs_digest"] or digests.commit_digest(c["parents"], spec, own) != digest:
                raise RuntimeError(f"commit {digest} does not have its digest")
        known = s.objects().select("digest").unionByName(s.remote_refs().select("digest"))
        none(integrity.refs_without_object(refs, known), "records without value")
        none(integrity.refs_without_schema(refs, s.schemas_table()), "columns without schema")
        for digest, schema in s.schemas().items():
            if schema.digest != digest:
                raise RuntimeError(f"schema {digest} does not have its digest")
        none(integrity.objects_changed(s.objects()), "values without their digest")
        if n := s.remote_refs().join(s.objects(), "digest", "left_anti").count():
            warnings.warn(f"{n} values are on remotes and were not verified", RuntimeWarning, stacklevel=3)
        if orphans := integrity.orphan_samples(refs).take(3):
            warnings.warn(f"samples of columns that are gone: {[tuple(r) for r in orphans]}", RuntimeWarning, stacklevel=3)
        return True
