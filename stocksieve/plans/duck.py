"""DuckDB spellings of the composed expressions, for the oracle SQL.

These are written independently of the Spark side (regex runs plus list
lambdas) so that a mistake in one engine's form shows up as a mismatch.
"""


def initcap(expr: str) -> str:
    """PostgreSQL initcap: letter/digit runs are words."""
    return ("array_to_string(list_transform(regexp_extract_all(" + expr +
            r", '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)'), lambda t: upper(left(t, 1)) || lower(substr(t, 2))), '')")


def title(expr: str) -> str:
    """Python str.title: letter runs are words."""
    return ("array_to_string(list_transform(regexp_extract_all(" + expr +
            r", '(\p{L}+|[^\p{L}]+)'), lambda t: upper(left(t, 1)) || lower(substr(t, 2))), '')")


def fund_name(expr: str = "fund_name") -> str:
    # DuckDB's left() already has the PostgreSQL meaning for negative n
    return initcap(f"trim(left({expr}, length({expr}) - 21))")
