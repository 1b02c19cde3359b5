"""Pieces of the SQL by which queries are checked."""

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"


def trim(x: str) -> str:
    return f"trim(coalesce({x}, ''), {WS})"


def rtrim_dots(x: str) -> str:
    return f"rtrim({x}, {WS} || '.')"


def sentence(x: str) -> str:
    return f"(CASE WHEN {trim(x)} = '' THEN '' ELSE {rtrim_dots(trim(x))} || '.' END)"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({trim(x)}), '[^a-z0-9]+', ' ', 'g'))"


def isbn(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9Xx]', '', 'g')"


def after(prefix: str, x: str, suffix: str = "") -> str:
    p, s = prefix.replace("'", "''"), suffix.replace("'", "''")
    return f"(CASE WHEN {x} = '' THEN '' ELSE '{p}' || {x} || '{s}' END)"


def line(*parts: str) -> str:
    return f"trim(concat_ws(' ', {', '.join(f"nullif({p}, '')" for p in parts)}), {WS})"


def authors(column: str = "authors") -> str:
    return f"list_filter(list_transform(coalesce({column}, []), lambda x: {trim('x')}), lambda x: x NOT IN ('', '0'))"


def joined(names: str, before_last: str) -> str:
    return f"(CASE len({names}) WHEN 0 THEN '' WHEN 1 THEN {names}[1] ELSE array_to_string({names}[1:len({names})-1], ', ') || '{before_last}' || {names}[len({names})] END)"


def first_said(*xs: str) -> str:
    return f"coalesce({', '.join(f"CASE WHEN coalesce({x}, '') NOT IN ('', '0') THEN {x} END" for x in xs)}, '')"
