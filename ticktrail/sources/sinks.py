"""Where results go: CSV that is never overwritten, metrics as text, and rows of the current connection only."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header in every file; quotes are doubled, an empty text is told from null, and an existing
    folder is refused. Arrays, maps and structs go as JSON."""
    kinds = dict(df.dtypes)
    flat = [F.to_json(c).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c in columns or df.columns]
    df.select(*flat).write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", '""').option("nullValue", "").csv(path)


def current_generation(df: DataFrame, generation: int, column: str = "generation") -> DataFrame:
    """Rows of this connection; what an older one left queued is discarded, and so are rows without one."""
    return df.where(F.col(column) == generation)


def metrics_text(values: dict[str, float], labels: dict[str, str] | None = None, prefix: str = "ticktrail_") -> str:
    """Lines of name{label="value"} number, sorted by name; quotes, backslashes and line ends are escaped."""
    esc = lambda v: str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    tags = ",".join(f'{k}="{esc(v)}"' for k, v in sorted((labels or {}).items()))
    return "".join(f"{prefix}{n}{{{tags}}} {v}\n" if tags else f"{prefix}{n} {v}\n" for n, v in sorted(values.items()))


class MetricsListener(StreamingQueryListener):
    """Writes each query's latest progress to one file of the driver's, replaced whole: a reader never sees
    half a file, and a newer batch wins over an older one."""

    def __init__(self, path: str):
        self.path, self.latest = path, {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        name = p.name or str(p.id)
        if p.batchId >= self.latest.get(name, {}).get("batch", -1):
            self.latest[name] = {"batch": p.batchId, "input_rows": p.numInputRows, "batch_ms": p.batchDuration}
            self.write()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def write(self) -> None:
        text = "".join(metrics_text(v, {"query": k}) for k, v in sorted(self.latest.items()))
        part = f"{self.path}.part"
        with open(part, "w") as f:
            f.write(text)
        os.replace(part, self.path)
