"""SQL of every registered query that DuckDB can express."""

from corpuswarden.duck import detectors, rules, tables

ORACLES = {f"rule_{check}": rules.rule_query(check)
           for check in dict.fromkeys(r[0] for r in rules.RULES)}
ORACLES.update(detectors.QUERIES)
ORACLES.update(tables.QUERIES)
