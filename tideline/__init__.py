"""tideline: market-relation analytics expressed as Spark DataFrame jobs.

Sub-packages
    sources    reading, typing and shaping inputs (snapshots, panels, edge files, cases)
    functions  Column expressions (names, text, numbers, node ids) and two small Arrow helpers
    operators  DataFrame -> DataFrame jobs (signals, factors, lead/lag, graph, text jobs, scoring)
    plans      wiring of operators to concrete tables, and the named queries
"""

__all__ = ["functions", "operators", "plans", "sources", "settings"]
