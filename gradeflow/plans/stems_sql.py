"""The rules of ``functions.stems`` as an SQL expression over a list of words."""

from __future__ import annotations

from gradeflow.functions.stems import IRREGULAR, SHORT, STEP2, STEP2_EXTENDED, STEP3, STEP4, Y_PAIRS


def _let(x: str, name: str, body: str) -> str:
    return f"list_extract(list_transform([{x}], lambda {name}: {body}), 1)"


def _shape(w: str) -> str:
    out = f"regexp_replace(regexp_replace(translate({w}, 'aeiou', 'VVVVV'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(Y_PAIRS):
        out = f"replace(replace({out}, 'Cy', 'CV'), 'Vy', 'VC')"
    return out


def _cut(w: str, n: int) -> str:
    return f"left({w}, greatest(length({w}) - {n}, 0)::bigint)"


def _some(s: str) -> str:
    return f"regexp_matches({s}, '^C*V+C')"


def _more(s: str) -> str:
    return f"regexp_matches({s}, '^C*V+C+V+C')"


def _one(s: str) -> str:
    return f"regexp_matches({s}, '^C*V+C+V*$')"


def _cvc(w: str, s: str) -> str:
    return f"((regexp_matches({s}, 'CVC$') and not regexp_matches({w}, '[wxy]$')) or {s} = 'VC')"


def _table(w: str, table: dict[str, str], fits: str) -> str:
    """``fits`` speaks of the suffix f and the stem t."""
    chosen = " ".join(f"when '{a}' then '{b}'" for a, b in table.items())
    inner = _let(f"left({w}, (length({w}) - length(f))::bigint)", "t", f"case when f <> '' and {fits} then concat(t, case f {chosen} end) else {w} end")
    return _let(f"regexp_extract({w}, '({'|'.join(table)})$', 1)", "f", inner)


def _mended(x: str) -> str:
    body = f"""case when regexp_matches({x}, '(at|bl|iz)$') then concat({x}, 'e')
      when length({x}) > 1 and right({x}, 1) = left(right({x}, 2), 1) and ends_with(s, 'C') then case when regexp_matches({x}, '[lsz]$') then {x} else {_cut(x, 1)} end
      when {_one('s')} and {_cvc(x, 's')} then concat({x}, 'e') else {x} end"""
    return _let(_shape(x), "s", body)


def _steps() -> list[str]:
    """One expression of a word w per step of the extended rules."""
    def cut(n: int) -> str:
        return _let(_cut("w", n), "x", f"case when contains({_shape('x')}, 'V') then {_mended('x')} else w end")

    first = f"case when ends_with(w, 'alli') and {_some(_shape(_cut('w', 4)))} then {_cut('w', 2)} else w end"
    logi = _some(_shape("case when f = 'logi' then concat(t, 'l') else t end"))
    return [
        f"""case when ends_with(w, 'sses') then {_cut('w', 2)} when ends_with(w, 'ies') then case when length(w) = 4 then {_cut('w', 1)} else {_cut('w', 2)} end
          when ends_with(w, 'ss') then w when ends_with(w, 's') then {_cut('w', 1)} else w end""",
        f"""case when ends_with(w, 'ied') then case when length(w) = 4 then {_cut('w', 1)} else {_cut('w', 2)} end
          when ends_with(w, 'eed') then case when {_some(_shape(_cut('w', 3)))} then {_cut('w', 1)} else w end
          when ends_with(w, 'ed') then {cut(2)} when ends_with(w, 'ing') then {cut(3)} else w end""",
        f"case when ends_with(w, 'y') and length(w) > 2 and ends_with({_shape(_cut('w', 1))}, 'C') then concat({_cut('w', 1)}, 'i') else w end",
        _let(first, "v", _table("v", STEP2 | STEP2_EXTENDED, logi)),
        _table("w", STEP3, _some(_shape("t"))),
        _table("w", dict.fromkeys(STEP4, ""), f"{_more(_shape('t'))} and (f <> 'ion' or regexp_matches(t, '[st]$'))"),
        f"case when ends_with(w, 'e') then {_let(_cut('w', 1), 'x', _let(_shape('x'), 's', f'case when {_more("s")} or ({_one("s")} and not {_cvc("x", "s")}) then x else w end'))} else w end",
        f"case when ends_with(w, 'll') and {_more(_shape(_cut('w', 1)))} then {_cut('w', 1)} else w end",
    ]


def stem_lists(source: str, columns: list[str], name: str) -> str:
    """View ``name``: the table ``source`` with the word lists of the columns replaced by their stems."""
    parts = [f"{name}_0 as (select *, {', '.join(f'{c} as {c}_s' for c in columns)} from {source})"]
    for i, step in enumerate(_steps()):
        changed = ", ".join(f"list_transform({c}_s, lambda w: {step}) as {c}_s" for c in columns)
        parts.append(f"{name}_{i + 1} as materialized (select * replace ({changed}) from {name}_{i})")
    irregular = " ".join(f"when '{a}' then '{b}'" for a, b in IRREGULAR.items())
    last = f"case when length(z[1]) <= {SHORT} then z[1] else coalesce(case z[1] {irregular} end, z[2]) end"
    stems = ", ".join(f"list_transform(list_zip({c}, {c}_s), lambda z: {last}) as {c}" for c in columns)
    gone = ", ".join(f"{c}_s" for c in columns)
    return ",\n".join([*parts, f"{name} as materialized (select * exclude ({gone}) replace ({stems}) from {name}_{len(_steps())})"])
