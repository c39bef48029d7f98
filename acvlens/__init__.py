"""acvlens: sales-pipeline analytics as Spark DataFrame plans.

Modules:
    params              parameters and the fixed values of the analyses
    session             session defaults, shared checkpoint folder, materialize()
    sources             declared schemas, landed tables, CSV export and sink, fixtures
    functions.exprs     NA-aware aggregates, rounding and number text, date parsing
    operators           edges, keep-first, reshape, joins, purchase gaps, statistics
    plans               the analyses (referral, clients, cycles, penetration),
                        the registry of query keys and their oracle SQL
    streaming.landing   incremental landing of CSV exports
    run                 run every analysis on landed tables
"""

__version__ = "0.1.0"
