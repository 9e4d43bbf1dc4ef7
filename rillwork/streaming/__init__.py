"""Optional streaming forms of incremental operators; the reference workloads are batch."""
