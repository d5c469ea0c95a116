"""Command line: ``python -m strataframe.cli --path REPO COMMAND``."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark import cloudpickle

from .functions.keys import Key
from .plans import importer, reports
from .plans.repository import Repository
from .service.server import serve
from .session import session, ship


def typed_key(text: str) -> Key:
    """``int:54`` is the integer key, ``str:54`` or ``54`` the string."""
    kind, _, rest = text.partition(":")
    if rest and kind in ("int", "str"):
        return int(rest) if kind == "int" else rest
    return text


def plugin(name: str):
    """A plugin's module; its functions go to the executors with their code, so it need not be installed there."""
    found = importlib.import_module(name)
    cloudpickle.register_pickle_by_value(found)
    return found


def plugin_args(extra: list[str]) -> dict[str, str]:
    """``--name value`` pairs for plugins."""
    if len(extra) % 2 or not all(a.startswith("--") for a in extra[::2]):
        raise SystemExit(f"arguments for a plugin come as --name value: {extra}")
    return {a[2:].replace("-", "_"): b for a, b in zip(extra[::2], extra[1::2], strict=True)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataframe")
    p.add_argument("--path", default=".")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple) -> None:
        c = sub.add_parser(name)
        for names, options in args:
            c.add_argument(*names.split(), **options)

    flag = {"action": "store_true"}
    command("init", ("--name", {"required": True}), ("--email", {"required": True}), ("--overwrite", flag))
    command("writer-lock", ("--force-release", flag))
    command("checkout", ("branch", {}))
    command("commit", ("-m --message", {"required": True}))
    command("column-create", ("name", {}), ("dtype", {}), ("shape", {"nargs": "*", "type": int}), ("--variable-shape", flag), ("--contains-subsamples", flag))
    command("column-remove", ("name", {}))
    command("clone", ("remote", {}), ("--name", {"required": True}), ("--email", {"required": True}), ("--overwrite", flag))
    command("fetch", ("remote", {}), ("branch", {}))
    command("fetch-data", ("remote", {}), ("startpoint", {}), ("-c --column", {"action": "append"}), ("-a --all-history", flag))
    command("push", ("remote", {}), ("branch", {}), ("--username", {"default": ""}), ("--password", {"default": ""}))
    command("server", ("--host", {"default": "127.0.0.1"}), ("--port", {"type": int, "default": 50051}), ("--username", {"default": ""}), ("--password", {"default": ""}))
    command("remote-list")
    command("remote-add", ("name", {}), ("address", {}))
    command("remote-remove", ("name", {}))
    command("diff", ("dev", {}), ("master", {"nargs": "?"}))
    command("summary", ("startpoint", {"nargs": "?"}))
    command("log", ("startpoint", {"nargs": "?"}))
    command("status")
    command("branch-list")
    command("branch-create", ("name", {}), ("startpoint", {"nargs": "?"}))
    command("branch-delete", ("name", {}), ("-f --force", flag))
    command("import", ("column", {}), ("folder", {}), ("--branch", {}), ("--plugin", {"required": True}), ("--overwrite", flag))
    command("export", ("column", {}), ("startpoint", {"nargs": "?"}), ("-o --out", {"required": True}), ("-s --sample", {"type": typed_key}), ("--plugin", {"required": True}))
    command("view", ("column", {}), ("sample", {"type": typed_key}), ("startpoint", {"nargs": "?"}), ("--plugin", {}))
    command("db-view", ("table", {"choices": ["objects", "refs", "commits", "heads", "schemas"]}), ("--limit", {"type": int, "default": 30}))
    return p


def _reader(repo: Repository, startpoint: str | None):
    if startpoint and startpoint not in repo.list_branches():
        return repo.checkout(commit=startpoint)
    return repo.checkout(branch=startpoint or "")


def main(argv: list[str] | None = None, spark=None) -> int:
    args, extra = parser().parse_known_args(argv)
    if args.command == "server":
        server = serve(args.path, args.host, args.port, args.username, args.password)
        print(f"serving {args.path} at http://{args.host}:{server.server_address[1]}", flush=True)
        server.serve_forever()
        return 0
    repo = Repository(ship(spark or session("strataframe-cli")), args.path)
    state = repo.store.state() if repo.initialized else {}
    match args.command:
        case "init":
            print(repo.init(args.name, args.email, remove_old=args.overwrite))
        case "writer-lock":
            print(repo.force_release_writer_lock() if args.force_release else f"held: {repo.writer_lock_held}")
        case "checkout":
            repo.checkout(write=True, branch=args.branch).close()
            print(f"staging is on {args.branch}")
        case "commit" | "column-create" | "column-remove" | "status":
            co = repo.checkout(write=True)
            try:
                if args.command == "commit":
                    print(co.commit(args.message))
                elif args.command == "status":
                    print(reports.status_text(co.branch_name, co.diff.staged()))
                elif args.command == "column-remove":
                    print(co.columns.delete(args.name))
                elif args.dtype.upper() in ("STR", "BYTES"):
                    getattr(co, f"add_{args.dtype.lower()}_column")(args.name, contains_subsamples=args.contains_subsamples)
                else:
                    co.add_ndarray_column(args.name, shape=tuple(args.shape), dtype=args.dtype.lower(), variable_shape=args.variable_shape, contains_subsamples=args.contains_subsamples)
            finally:
                co.close()
        case "clone":
            print(repo.clone(args.name, args.email, args.remote, remove_old=args.overwrite))
        case "fetch":
            print(repo.remote.fetch(args.remote, args.branch))
        case "fetch-data":
            at = {"branch": args.startpoint} if f"{args.remote}/{args.startpoint}" in repo.list_branches() or args.startpoint in repo.list_branches() else {"commit": args.startpoint}
            print(repo.remote.fetch_data(args.remote, **at, column_names=args.column, retrieve_all_history=args.all_history))
        case "push":
            print(repo.remote.push(args.remote, args.branch, username=args.username, password=args.password))
        case "remote-list":
            print(repo.remote.list_all())
        case "remote-add":
            print(repo.remote.add(args.name, args.address))
        case "remote-remove":
            print(repo.remote.remove(args.name))
        case "diff":
            d = repo.diff(args.master or state["branch"], args.dev)
            print(reports.status_text(args.dev, d))
            if d.has_conflict:
                print(f"CONFLICTS {d.conflict}")
        case "summary":
            co = _reader(repo, args.startpoint)
            print(reports.summary(repo.store, co.commit_hash))
        case "log":
            co = _reader(repo, args.startpoint)
            reports.log(repo.store, co.commit_hash, show_time=True, show_user=True)
        case "branch-list":
            print("\n".join(repo.list_branches()))
        case "branch-create":
            base = repo.store.heads().get(args.startpoint, args.startpoint)
            print(repo.create_branch(args.name, base))
        case "branch-delete":
            print(repo.remove_branch(args.name, force_delete=args.force))
        case "import":
            load, more = plugin(args.plugin).load, plugin_args(extra)
            n = importer.import_files(repo, args.branch or state["branch"], args.column, args.folder, lambda path, content: load(path, content, **more), overwrite=args.overwrite)
            print(f"{n} samples staged")
        case "export":
            print(importer.export_files(_reader(repo, args.startpoint), args.column, plugin(args.plugin).save, args.out, args.sample))
        case "view":
            value = _reader(repo, args.startpoint)[args.column, args.sample]
            print(plugin(args.plugin).show(value) if args.plugin else value)
        case "db-view":
            print("\n".join(reports.details(repo.store, args.table, args.limit)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
