"""Files of any store that tasks can reach, opened outside Spark's readers."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(uri: str, stores: dict) -> tuple[fs.FileSystem, str]:
    """The store of a file and its path there; one store for each scheme and host."""
    if "://" not in uri:
        return stores.setdefault("file", fs.LocalFileSystem()), re.sub(r"^file:", "", uri)
    scheme, rest = uri.split("://", 1)
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)  # the store's own name
    host = rest.split("/", 1)[0]
    if scheme == "file":
        return stores.setdefault("file", fs.LocalFileSystem()), rest[len(host) :]
    if (scheme, host) not in stores:
        stores[scheme, host] = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    store, root = stores[scheme, host]
    return store, root.rstrip("/") + rest[len(host) :] if scheme in ("hdfs", "viewfs") else rest
