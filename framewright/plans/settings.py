"""Settings and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import ClassVar

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Settings:
    # Defaults of the tunables.
    network_transport: str = "ucx"
    monitor_rpc_duration: bool = False
    enable_stf_transfer_tokens: bool = True
    num_pages_in_topological_stf: int = 128
    start_topological_stf_on_new_orbit: bool = True
    stf_buffer_size_mb: int = 32 << 10
    stale_stf_timeout_ms: int = 60_000
    standalone_stf_delete_chance: int = 25
    standalone_stf_data_buffer_size_mb: int = 128
    rdma_gap_b: int = 8192
    sender_thread_pool_size: int = 8
    max_num_stf_transfers: int = 300
    sender_selection: str = "random"
    stf_data_request_timeout_ms: int = 100
    sender_rpc_thread_pool_size: int = 8
    builder_thread_pool_size: int = 1
    poll_for_completion: bool = False
    max_stf_size_for_concurrent_fetch_b: int = 2 << 20
    max_num_tfs_in_building: int = 5
    build_incomplete_tfs: bool = True
    stale_tf_timeout_ms: int = 750
    token_reset_timeout_ms: int = 5000
    tokens_per_sender: int = 2

    #: Limits to which values are brought.
    LIMITS: ClassVar[dict[str, tuple[int, int]]] = {"num_pages_in_topological_stf": (1, 50_000), "stf_buffer_size_mb": (8 << 10, 64 << 10), "stale_stf_timeout_ms": (5000, 300_000), "max_num_stf_transfers": (2, 5000), "stale_tf_timeout_ms": (25, 60_000)}

    @classmethod
    def of(cls, given: dict[str, str]) -> Settings:
        """From texts: bad or missing values leave the default."""
        out = cls()
        for f in fields(cls):
            text = given.get(f.name)
            if text is None:
                continue
            default = getattr(out, f.name)
            if isinstance(default, bool):
                value = text in ("true", "TRUE", "True", "1")
            elif isinstance(default, int):
                if not text.strip().isdigit():
                    continue
                lo, hi = cls.LIMITS.get(f.name, (0, 1 << 62))
                value = min(hi, max(lo, int(text)))
            else:
                value = text
            out = replace(out, **{f.name: value})
        return out

    @classmethod
    def read(cls, table: DataFrame) -> Settings:
        """From a table (key, value) of settings; the keys are few."""
        return cls.of({r.key: r.value for r in table.where(table.key.isin([f.name for f in fields(cls)])).collect()})

    def missing(self, table: DataFrame) -> DataFrame:
        """(key, value) of the settings that the table (key, value) has no row for, to be appended to it."""
        text = lambda x: str(x).lower() if isinstance(x, bool) else str(x)
        own = table.sparkSession.createDataFrame([(f.name, text(getattr(self, f.name))) for f in fields(self)], "key string, value string")
        return own.join(table.select("key"), "key", "left_anti")

    @classmethod
    def of_environment(cls, environment: dict[str, str], prefix: str = "FRAMEWRIGHT_") -> Settings:
        """From variables such as FRAMEWRIGHT_STALE_TF_TIMEOUT_MS."""
        return cls.of({k.removeprefix(prefix).lower(): v for k, v in environment.items() if k.startswith(prefix)})
