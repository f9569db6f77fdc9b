"""Source configuration: a TOML text or an equal dict, resolved into one timeline of readers.

```
[sources]
docker = true                # container logs, read from `container_logs`
stdin = "pipe"               # a line stream, given as `stdin_lines`
[[sources.file]]
path = "logs/app.log"
label = "app"                # optional, the file name otherwise
[[sources.process]]
label = "api"                # captured output, given in `process_output`
cmd = "..."                  # never run
```
"""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession

from ..operators.merge import merge_sources
from .lines import from_lines, read_containers, read_lines, read_process_output

_RESTART = ("never", "always", "on-failure")


def parse_config(text: str) -> dict:
    """The configuration in a TOML text; ``ValueError`` when it is malformed."""
    try:
        config = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ValueError(f"invalid TOML: {error}") from None
    return check_config(config)


def check_config(config: dict) -> dict:
    sources = config.get("sources", {})
    if not isinstance(sources, dict):
        raise ValueError("`sources` must be a table")
    if not isinstance(sources.get("docker", False), bool):
        raise ValueError("`sources.docker` must be true or false")
    if not isinstance(sources.get("stdin", ""), str):
        raise ValueError("`sources.stdin` must be a label")
    for kind, required in (("file", ("path",)), ("process", ("label", "cmd"))):
        for entry in sources.get(kind, []):
            missing = [key for key in required if not isinstance(entry.get(key), str)]
            if missing:
                raise ValueError(f"a `sources.{kind}` entry needs {', '.join(missing)}")
            if entry.get("restart", "never") not in _RESTART:
                raise ValueError(f"`restart` must be one of {', '.join(_RESTART)}")
    return config


def sources_from_config(
    spark: SparkSession,
    config: dict,
    stream: bool = False,
    container_logs: str | None = None,
    process_output: dict[str, str] | None = None,
    stdin_lines: DataFrame | None = None,
) -> DataFrame | None:
    """All configured sources merged, or null when none is configured, with the columns that give their lines' order.

    Commands are not run and no container socket is opened: their lines come in as files.
    """
    sources = check_config(config).get("sources", {})
    frames = []
    if sources.get("docker"):
        if container_logs is None:
            raise ValueError("`docker = true` needs `container_logs`, the folder of container log files")
        frames.append(read_containers(spark, container_logs, stream=stream))
    for entry in sources.get("file", []):
        frames.append(read_lines(spark, entry["path"], entry.get("label"), stream, positions=True))
    for entry in sources.get("process", []):
        output = (process_output or {}).get(entry["label"])
        if output is None:
            raise ValueError(f"process {entry['label']!r} needs its captured output in `process_output`")
        frames.append(read_process_output(spark, output, entry["label"], stream))
    if "stdin" in sources:
        if stdin_lines is None:
            raise ValueError("`stdin` needs `stdin_lines`, a DataFrame of lines")
        frames.append(from_lines(stdin_lines, stdin_lines.columns[0], sources["stdin"], positions=True))
    return merge_sources(*frames) if frames else None
