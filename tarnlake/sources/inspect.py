"""python -m tarnlake.sources.inspect FILE...: what the footers and headers of Parquet, ORC and Avro files say, as JSON."""

from __future__ import annotations

import json
import sys

from tarnlake.sources import avro_codec, files


def describe(path: str) -> dict:
    if path.endswith(".orc"):
        return files.orc_metadata(path)
    if path.endswith(".avro"):
        with open(path, "rb") as f:
            schema, meta, _ = avro_codec.read_header(f)
        return {"schema": schema, "codec": meta.get("avro.codec", b"null").decode(), "fingerprint": avro_codec.fingerprint(schema).hex()}
    return files.parquet_metadata(path)


def main(paths: list[str]) -> int:
    for p in paths:
        print(json.dumps({"file": p, **describe(p)}, default=str, indent=1))
    return 0 if paths else 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
