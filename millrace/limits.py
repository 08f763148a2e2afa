"""Bounds of job graphs and of the data of jobs."""

from __future__ import annotations

from dataclasses import dataclass

INT64 = (-(1 << 63), (1 << 63) - 1)


@dataclass(frozen=True)
class Limits:
    # Fixed values.
    document_bytes: int = 1 << 20
    identifier_bytes: int = 64
    stages: int = 64
    edges: int = 256
    tasks_per_stage: int = 256
    tasks_per_job: int = 1024
    settings_per_stage: int = 32
    setting_key_bytes: int = 64
    setting_value_bytes: int = 1024
    total_settings_bytes: int = 64 << 10
    operator_outputs: int = 16
    words_per_line: int = 16
    derived_deliveries: int = 4096
    topology_bytes: int = 118_784
    source_sequences: int = 1_000_000
    range_length: int = 256_000_000
    tuple_bytes: int = 512
    result_bytes_per_job: int = 64 << 20
    active_jobs: int = 64
    retained_jobs: int = 256
    page_bytes: int = 512 << 10
    page_records: int = 3084
    default_page_bytes: int = 64 << 10
    record_overhead_bytes: int = 168

    #: Off for runs over large tables: rows of a source partition, bytes of a tuple and of a job's results.
    data_limits: bool = True


DEFAULT = Limits()
