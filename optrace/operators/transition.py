"""What one operation does to a file tree: the ordered part of replay.

Spark decides which rows meet here and in which order (see replay); this is only the step.
A store maps paths to entries, and can list the names directly below a directory."""

from __future__ import annotations

# Entry: [is_dir, mode, owner, group, mtime, size, content]
IS_DIR, MODE, OWNER, GROUP, MTIME, SIZE, CONTENT = range(7)

DEFAULT_FILE_MODE = 0o644
DEFAULT_DIR_MODE = 0o755

ERRNO = {
    "mkdir": "EEXIST", "create": "EEXIST", "symlink": "EEXIST", "link": "EEXIST",
    "unlink": "ENOENT", "rmdir": "ENOENT", "chmod": "ENOENT", "chown": "ENOENT", "rename": "ENOENT",
    "write": "EIO", "truncate": "EIO",
}


class Rejected(Exception):
    """The operation fails and leaves the state as it was."""


class DictStore:
    """Entries of the paths one group owns."""

    def __init__(self):
        self.entries, self.names = {}, {}

    def get(self, path):
        return self.entries.get(path)

    def put(self, path, entry):
        if path not in self.entries and path:
            self.names.setdefault(parent_of(path), set()).add(path)
        self.entries[path] = entry

    def drop(self, path):
        del self.entries[path]
        self.names.get(parent_of(path), set()).discard(path)

    def below(self, path):
        """Paths directly below, in name order."""
        return sorted(self.names.get(path, ()))


def parent_of(path):
    return path.rpartition("/")[0]


def spliced(entry, data, length, offset):
    """Content and size after a write. Bytes that are not known in full make the content
    unknown, unless the write covers the whole file."""
    size = max(entry[SIZE], offset + length)
    raw = None if data is None else data.encode("utf-8")
    if raw is None or len(raw) != length:
        return None, size
    if entry[CONTENT] is None:
        whole = offset == 0 and length >= entry[SIZE]
        return (data if whole else None), size
    old = entry[CONTENT].encode("utf-8")
    new = old[:offset].ljust(offset, b"\0") + raw + old[offset + length:]
    return new.decode("utf-8", "replace"), size


def resized(entry, length):
    if entry[CONTENT] is None:
        return "" if length == 0 else None
    return entry[CONTENT].encode("utf-8")[:length].ljust(length, b"\0").decode("utf-8", "replace")


def apply(store, op, parent_fixed, new_parent_fixed):
    """Run one operation; returns [(path, entry before, entry after)] in order, with None for
    no entry, or raises Rejected.

    parent_fixed says that the parent is a directory no operation of this session touches,
    so it need not be looked up."""
    kind, path = op.operation, op.path
    entry = store.get(path)
    changes = []

    def put(at, value):
        changes.append((at, store.get(at), value))
        store.put(at, value)

    def drop(at):
        changes.append((at, store.get(at), None))
        store.drop(at)

    def need_parent(at, fixed):
        above = None if fixed else store.get(parent_of(at))
        if not fixed and (above is None or not above[IS_DIR]):
            raise Rejected("parent_missing")

    def need_file():
        if entry is None:
            raise Rejected("missing")
        if entry[IS_DIR]:
            raise Rejected("is_directory")

    def number(value, default):
        return default if value is None else int(value)

    if kind == "mkdir":
        if entry is not None:
            raise Rejected("exists")
        need_parent(path, parent_fixed)
        put(path, [True, number(op.mode, DEFAULT_DIR_MODE), "root", "root", op.mtime, 0, None])
    elif kind == "create":
        if entry is not None and entry[IS_DIR]:
            raise Rejected("is_directory")
        need_parent(path, parent_fixed)
        if entry is None:
            put(path, [False, number(op.mode, DEFAULT_FILE_MODE), "root", "root", op.mtime, 0, ""])
        else:
            put(path, entry[:MTIME] + [op.mtime, 0, ""])
    elif kind == "write":
        need_file()
        offset = number(op.offset, 0)
        known = len((op.data or "").encode("utf-8"))
        content, size = spliced(entry, op.data, number(op.data_length, known), offset)
        put(path, entry[:MTIME] + [op.mtime, size, content])
    elif kind == "truncate":
        need_file()
        length = number(op.length, 0)
        put(path, entry[:MTIME] + [op.mtime, length, resized(entry, length)])
    elif kind == "unlink":
        need_file()
        drop(path)
    elif kind == "rmdir":
        if entry is None:
            raise Rejected("missing")
        if not entry[IS_DIR]:
            raise Rejected("not_directory")
        if path == "" or store.below(path):
            raise Rejected("not_empty")
        drop(path)
    elif kind == "rename":
        rename(store, entry, path, op.new_path, need_parent, new_parent_fixed, put, drop)
    elif kind in ("chmod", "chown"):
        if entry is None:
            raise Rejected("missing")
        if kind == "chmod":
            put(path, entry[:MODE] + [number(op.mode, entry[MODE])] + entry[OWNER:])
        else:
            owner = entry[OWNER] if op.uid in (None, "-1") else op.uid
            group = entry[GROUP] if op.gid in (None, "-1") else op.gid
            put(path, entry[:OWNER] + [owner, group] + entry[MTIME:])
    elif kind in ("link", "symlink"):
        if store.get(op.new_path) is not None:
            raise Rejected("exists")
        need_parent(op.new_path, new_parent_fixed)
        if entry is None:
            # A dangling symbolic link is made, but no capture ever shows it.
            if kind == "link":
                raise Rejected("missing")
        elif entry[IS_DIR] and kind == "link":
            raise Rejected("is_directory")
        else:
            put(op.new_path, list(entry))
    return changes


def rename(store, entry, path, new_path, need_parent, new_parent_fixed, put, drop):
    if entry is None:
        raise Rejected("missing")
    if new_path == path:
        return
    if path == "" or new_path == "" or new_path.startswith(path + "/"):
        raise Rejected("into_itself")
    need_parent(new_path, new_parent_fixed)
    there = store.get(new_path)
    if there is not None:
        if there[IS_DIR] != entry[IS_DIR]:
            raise Rejected("kind_clash")
        if there[IS_DIR] and store.below(new_path):
            raise Rejected("not_empty")
    pending = [path]
    moved = []
    while pending:
        at = pending.pop()
        moved.append((at, store.get(at)))
        pending.extend(store.below(at))
    for at, _ in reversed(moved):
        drop(at)
    for at, value in moved:
        put(new_path + at[len(path):], value)


def errno_of(kind, reason):
    return "EIO" if kind == "create" and reason == "is_directory" else ERRNO.get(kind)
