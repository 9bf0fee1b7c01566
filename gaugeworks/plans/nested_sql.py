"""The flat child tables of nested columns as SQL of the second engine."""


def _decoded(rows: str, more: str = "", rounds: int = 3) -> str:
    sql = f"select row_number() over () as rid, id{more}, case when json_valid(j) then json(j) end as v from ({rows})"
    for _ in range(rounds):
        sql = f"select rid, id{more}, case when json_type(v) = 'VARCHAR' then case when json_valid(v ->> '$') then json(v ->> '$') end else v end as v from ({sql})"
    return sql


def decoded(table: str, column: str, more: str = "") -> str:
    """(rid, id, v): the JSON values of a column, those that are encoded several times decoded; unreadable ones are left out."""
    rows = f"select distinct id{more}, {column} as j from {table} where id is not null and {column} is not null"
    return f"select * from ({_decoded(rows, more)}) where v is not null and json_type(v) <> 'NULL'"


def _unwrapped(source: str, labels: tuple[str, ...]) -> str:
    """(rid, id, path, v): values without the objects that wrap them whole; ``path`` names the wrapper."""
    inner = ", ".join(f"case when json_type(v -> '$.{x}') in ('ARRAY', 'OBJECT') then '{x}' end" for x in labels)
    return (
        f"select rid, id, coalesce('wrapped:' || w || '/', '') as path, case when w is null then v else json_extract(v, '$.' || w) end as v "
        f"from (select *, case when json_type(v) = 'OBJECT' then coalesce({inner}) end as w from ({source}))"
    )


def _text(x: str) -> str:
    """A text given plainly, as a number or as an object with one of some labels."""
    parts = ", ".join(f"case when json_type({x} -> '$.{k}') = 'VARCHAR' then {x} ->> '$.{k}' end" for k in ("plain", "text", "html", "why"))
    return f"case when json_type({x}) = 'VARCHAR' then {x} ->> '$' when json_type({x}) = 'OBJECT' then coalesce({parts}) when json_type({x}) in ('BIGINT', 'UBIGINT', 'DOUBLE') then {x}::varchar end"


def _string(x: str, key: str) -> str:
    return f"case when json_type({x} -> '$.{key}') = 'VARCHAR' then {x} ->> '$.{key}' end"


def _letter(key: str, position: str) -> str:
    place = f"case when {position} < 26 then chr(65 + {position}::int) else chr(64 + ({position} // 26)::int) || chr(65 + ({position} % 26)::int) end"
    return f"coalesce(nullif(upper(trim({key})), ''), {place})"


def number(x: str) -> str:
    """The number of an id however it was written, as ``plain_number`` reads it; ``x`` is JSON."""
    written = f"regexp_extract({x} ->> '$', '^\\s*[A-Za-z_#]{{0,3}}[\\s:#_-]*([0-9]{{1,18}})(?:\\.0*)?\\s*$', 1)"
    return (
        f"case when json_type({x}) in ('BIGINT', 'UBIGINT') and ({x})::hugeint >= 0 then try_cast({x} as bigint) when json_type({x}) = 'DOUBLE' and ({x})::double >= 0 and ({x})::double = floor(({x})::double) then ({x})::double::bigint "
        f"when json_type({x}) = 'VARCHAR' then try_cast(nullif({written}, '') as bigint) end"
    )


# elements of arrays and entries of objects with their places; an array of arrays is no known shape
_ARRAY = """elements as (select rid, id, path || case when list_contains(types, 'OBJECT') then 'objects' when len(types) > 0 then 'texts' else 'empty' end as variant, unnest(xs) as x, unnest(range(len(xs))) as position, null::varchar as entry
from (select *, list_transform(xs, lambda e: json_type(e)) as types from (select rid, id, path, json_extract(v, '$[*]') as xs from unwrapped where json_type(v) = 'ARRAY')) where not list_contains(types, 'ARRAY'))"""
_MAP = """entries as (select rid, id, path || 'map' as variant, json_extract(v, '$."' || entry || '"') as x, position, entry from (select rid, id, path, v, unnest(json_keys(v)) as entry, unnest(range(len(json_keys(v)))) as position
from unwrapped where json_type(v) = 'OBJECT' and json_extract(v, '$.key') is null and len(list_filter(json_keys(v), lambda k: not regexp_matches(k, '^\\s*([A-Za-z]|[A-Za-z_]{0,3}[\\s:#_-]*[0-9]+(\\.0*)?)\\s*$'))) = 0))"""
_SINGLE = """singles as (select rid, id, path || 'single' as variant, v as x, 0::bigint as position, null::varchar as entry from unwrapped where json_type(v) = 'OBJECT' and json_extract(v, '$.key') is not null)"""

#: The first child of each key in a value.
_FIRST = "qualify row_number() over (partition by rid, child_key order by position) = 1"


def option() -> str:
    inner = "(case when json_type(x) = 'OBJECT' and json_extract(x, '$.text') is not null then json_extract(x, '$.text') else x end)"
    return f"""with unwrapped as ({_unwrapped(decoded('questions', 'options_json'), ('options', 'items', 'data'))}), {_ARRAY}, {_MAP}, {_SINGLE},
rows_ as (select *, {inner} as t from (select * from elements union all select * from entries union all select * from singles) where entry is not null or json_type(x) <> 'NULL'),
keyed as (select rid, 'questions' as parent_table, id as parent_id, 'option' as child_kind, {_letter("coalesce(entry, case when json_type(x) = 'OBJECT' then " + _string('x', 'key') + " end)", 'position')} as child_key, position, variant, {_text('t')} as text,
case when json_type(x) = 'OBJECT' and json_type(t) = 'OBJECT' then {_string('t', 'html')} end as html, case when json_type(x -> '$.meta.shuffled') = 'BOOLEAN' then (x -> '$.meta.shuffled')::boolean end as shuffled from rows_)
select distinct * exclude (rid) from (select * from keyed {_FIRST})"""


def justification() -> str:
    why = "case when json_type(x) = 'OBJECT' then coalesce(json_extract(x, '$.why'), json_extract(x, '$.justification'), json_extract(x, '$.text'), x) else x end"
    return f"""with unwrapped as ({_unwrapped(decoded('questions', 'justifications_json'), ('justifications', 'items', 'data'))}), {_ARRAY}, {_MAP}, {_SINGLE},
rows_ as (select *, {why} as t from (select * from elements union all select * from entries union all select * from singles)),
keyed as (select rid, 'questions' as parent_table, id as parent_id, 'justification' as child_kind, {_letter("coalesce(entry, case when json_type(x) = 'OBJECT' then " + _string('x', 'key') + " end)", 'position')} as child_key, position, variant, {_text('t')} as text from rows_)
select distinct * exclude (rid) from (select * from keyed where trim(coalesce(text, '')) <> '' {_FIRST})"""


def evidence() -> str:
    chunk = "(case when json_type(x) = 'OBJECT' then coalesce(json_extract(x, '$.chunk_id'), json_extract(x, '$.id')) else x end)"
    line = lambda i, k: (
        f"case when json_type(x -> '$.lines') = 'VARCHAR' then try_cast(nullif(regexp_extract(x ->> '$.lines', '^\\s*([0-9]+)\\s*(?:-|–|:)\\s*([0-9]+)\\s*$', {i}), '') as bigint) "
        f"when json_type(x -> '$.lines') = 'OBJECT' then {number(f'(x -> {chr(39)}$.lines.{k}{chr(39)})')} end"
    )
    lone = "(json_type(v) in ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') or json_type(v) = 'OBJECT' and coalesce(v -> '$.chunk_id', v -> '$.title', v -> '$.file') is not null)"
    return f"""with unwrapped as ({_unwrapped(decoded('questions', 'evidence_json'), ('evidence', 'items', 'chunks', 'data'))}), {_ARRAY},
rows_ as (select * from elements union all select rid, id, path || 'single', v, 0::bigint, null from unwrapped where {lone}),
keyed as (select 'questions' as parent_table, id as parent_id, 'evidence' as child_kind, position::varchar as child_key, position, variant, 'c' || ({number(chunk)})::varchar as chunk_id, {_string('x', 'title')} as title, {_string('x', 'file')} as file,
{line(1, 'start')} as start_line, {line(2, 'end')} as end_line, {_string('x', 'snapshot')} as snapshot from rows_ where json_type(x) <> 'NULL')
select distinct * from keyed"""


_SCORES = f"""unwrapped as ({_unwrapped(decoded('attempts', 'score_json'), ('result', 'score', 'data'))}), scores as (select rid, id, path || 'score' as variant, v from unwrapped where json_type(v) = 'OBJECT' and coalesce(v -> '$.per_question', v -> '$.per_focus') is not null)"""
_ANSWERED = f"""{_SCORES}, listed as (select rid, id, variant, unnest(xs) as x, unnest(range(len(xs))) as position, null::varchar as entry from (select *, json_extract(v, '$.per_question[*]') as xs from scores where json_type(v -> '$.per_question') = 'ARRAY')
union all select rid, id, variant, json_extract(v, '$.per_question."' || entry || '"'), position, entry from (select *, unnest(json_keys(v, '$.per_question')) as entry, unnest(range(len(json_keys(v, '$.per_question')))) as position from scores where json_type(v -> '$.per_question') = 'OBJECT')),
raw as (select *, case when entry is null then x -> '$.question_id' else to_json(entry) end as q from listed where json_type(x) = 'OBJECT'),
answered as (select rid, id, variant, x, position, qid from (select *, coalesce(({number('q')})::varchar, case when json_type(q) = 'VARCHAR' then nullif(trim(q ->> '$'), '') end) as qid from raw) where qid is not null)"""


def _letters(x: str) -> str:
    items = f"case when json_type({x}) = 'ARRAY' then list_transform(json_extract({x}, '$[*]'), lambda e: case when json_type(e) = 'VARCHAR' then e ->> '$' end) when json_type({x}) = 'VARCHAR' then regexp_split_to_array({x} ->> '$', '[,;/|\\s]+') else [] end"
    return f"list_filter(list_transform({items}, lambda e: upper(trim(e))), lambda e: e is not null and e <> '')"


def _once(xs: str) -> str:
    """A list without repeats, in the order of their first places."""
    return f"list_filter({xs}, lambda e, i: list_position({xs}, e) = i)"


def per_question() -> str:
    return f"""with {_ANSWERED}, keyed as (select rid, 'attempts' as parent_table, id as parent_id, 'per_question' as child_kind, qid as child_key, position, variant, case when json_type(x -> '$.correct') = 'BOOLEAN' then (x -> '$.correct')::boolean end as correct,
array_to_string({_once('ls')}, ',') as answer, {_string('x', 'explanation')} as explanation from (select *, {_letters("(x -> '$.answer')")} as ls from answered))
select distinct * exclude (rid) from (select * from keyed {_FIRST})"""


def selected() -> str:
    return f"""with {_ANSWERED}, each as (select rid, id, variant, position, qid, unnest({_letters("(x -> '$.selected')")}) as letter from answered),
keyed as (select rid, 'attempts' as parent_table, id as parent_id, 'selected' as child_kind, qid || '/' || letter as child_key, position, variant, letter, qid as question_id from each)
select distinct * exclude (rid) from (select * from keyed {_FIRST})"""


def per_focus() -> str:
    return f"""with {_SCORES}, listed as (select rid, id, variant, unnest(xs) as x, unnest(range(len(xs))) as position, null::varchar as entry from (select *, list_filter(json_extract(v, '$.per_focus[*]'), lambda e: json_type(e) = 'OBJECT') as xs from scores where json_type(v -> '$.per_focus') = 'ARRAY')
union all select rid, id, variant, json_extract(v, '$.per_focus."' || entry || '"'), position, entry from (select *, unnest(json_keys(v, '$.per_focus')) as entry, unnest(range(len(json_keys(v, '$.per_focus')))) as position from scores where json_type(v -> '$.per_focus') = 'OBJECT')),
keyed as (select rid, 'attempts' as parent_table, id as parent_id, 'per_focus' as child_kind, trim(coalesce(entry, {_string('x', 'area')}, {_string('x', 'focus')})) as child_key, position, variant, {number("(x -> '$.correct')")} as correct, {number("(x -> '$.total')")} as total from listed)
select distinct * exclude (rid) from (select * from keyed where child_key <> '' {_FIRST})"""


SUBTYPES = {"option": option, "justification": justification, "evidence": evidence, "per_question": per_question, "selected": selected, "per_focus": per_focus}


def children() -> str:
    return "select distinct * from (" + " union all ".join(f"select parent_table, parent_id, child_kind, child_key from ({f()})" for f in SUBTYPES.values()) + ")"


_DATA = "'^\\s*([A-Za-z]|[A-Za-z_]{0,3}[\\s:#_-]*[0-9]+(\\.0*)?)\\s*$'"
_LABELS = {
    ("questions", "options_json"): ("options", "items", "data"), ("questions", "justifications_json"): ("justifications", "items", "data"),
    ("questions", "evidence_json"): ("evidence", "items", "chunks", "data"), ("attempts", "score_json"): ("result", "score", "data"),
}


def shapes() -> str:
    """How many values of a column are of which variant."""
    parts = []
    for (table, column), labels in _LABELS.items():
        array = "null" if column == "score_json" else "case when list_contains(types, 'ARRAY') then null when list_contains(types, 'OBJECT') then 'objects' when len(types) > 0 then 'texts' else 'empty' end"
        if column == "score_json":
            known = "case when list_has_any(ks, ['per_question', 'per_focus']) then 'score' when len(list_filter(ks, lambda k: not list_contains(['correct', 'total', 'percent'], k))) = 0 then 'empty' end"
        elif column == "evidence_json":
            known = "case when list_has_any(ks, ['chunk_id', 'title', 'file']) then 'single' when len(ks) = 0 then 'empty' end"
        else:
            known = f"case when list_contains(ks, 'key') then 'single' when len(ks) = 0 then 'empty' when len(list_filter(ks, lambda k: not regexp_matches(k, {_DATA}))) = 0 then 'map' end"
        leaf = "'single'" if column == "evidence_json" else "null"
        kept = f"select * from ({_decoded(f'select null::bigint as id, {column} as j from {table}')})"
        texts = f"select count(*) as n, count(*) filter ({column} is null) as nulls, count(*) filter (trim({column}) = '') as blanks from {table}"
        values = f"select *, coalesce(path || case json_type(v) when 'ARRAY' then {array} when 'OBJECT' then {known} else {leaf} end, 'unknown') as variant from (select *, list_transform(json_extract(v, '$[*]'), lambda e: json_type(e)) as types, json_keys(v) as ks from ({_unwrapped(f'select * from ({kept}) where v is not null and json_type(v) <> {chr(39)}NULL{chr(39)}', labels)}))"
        parts.append(f"select '{table}' as parent_table, '{column}' as column_name, variant, count(*) as n from ({values}) group by variant")
        nulls = f"(select count(*) from ({kept}) where json_type(v) = 'NULL')"
        read = f"(select count(*) from ({kept}) where v is not null)"
        parts.append(
            f"select '{table}', '{column}', variant, n from (select unnest(['null', 'blank', 'unreadable']) as variant, unnest([nulls + {nulls}, blanks, n - nulls - blanks - {read}]) as n from ({texts})) where n > 0"
        )
    return " union all ".join(parts)


def _ids(table: str, column: str, time: str, parts: str, more: str = "") -> str:
    """(ref_table, ref_id, ref_time, key, more) of the numbers in a column; ``parts`` gives the list of JSON values with ids from ``v``."""
    extra = f", epoch_us({time}) as ref_time{more}"
    rows = f"select distinct id{extra}, {column} as j from {table} where id is not null and {column} is not null"
    names = ", ref_time" + "".join(f", {m.split(' as ')[-1].strip()}" for m in more.split(",") if m.strip())
    return (
        f"select distinct '{table}' as ref_table, id as ref_id{names}, {number('x')} as key from (select id{names}, unnest({parts}) as x from ({_decoded(rows, names)}) where v is not null)"
    )


def _each(v: str, first: str, second: str) -> str:
    """The ids in a value: of each element of an array, or of the value alone."""
    of = lambda e: f"case when json_type({e}) = 'OBJECT' then coalesce(json_extract({e}, '$.{first}'), json_extract({e}, '$.{second}')) else {e} end"
    return f"case when json_type({v}) = 'ARRAY' then list_transform(json_extract({v}, '$[*]'), lambda e: {of('e')}) else [{of(v)}] end"


def _orphans() -> str:
    inner = "(case when json_type(v) = 'OBJECT' and json_type(v -> '$.{0}') in ('ARRAY', 'OBJECT') then v -> '$.{0}' else v end)"
    listed = "(case when json_type(v) = 'OBJECT' then coalesce(json_extract(v, '$.question_ids'), json_extract(v, '$.ids')) else v end)"
    given = "(case when json_type(v) = 'OBJECT' and len(json_keys(v)) <= 3 and json_type(v -> '$.responses') in ('ARRAY', 'OBJECT') then v -> '$.responses' else v end)"
    keys = f"case when json_type({given}) = 'OBJECT' then case when json_extract({given}, '$.question_id') is not null then [json_extract({given}, '$.question_id')] else list_transform(json_keys({given}), lambda k: to_json(k)) end when json_type({given}) = 'ARRAY' then {_each(given, 'question_id', 'id')} else [] end"
    chunks = _each(inner.format("evidence"), "chunk_id", "id")
    return f"""to_questions as (select * from ({_ids('assessments', 'question_ids_json', 'created_at', _each(listed, 'question_id', 'id'))} union all {_ids('attempts', 'responses_json', 'submitted_at', keys)}) where key is not null),
to_chunks as (select * from ({_ids('questions', 'evidence_json', 'created_at', chunks, ', project_id')}) where key is not null),
q_times as (select id, min(epoch_us(created_at)) as since from questions group by id), p_times as (select id, min(epoch_us(created_at)) as since from projects group by id),
there as (select distinct id, regexp_extract(c, '^\\s*[A-Za-z]?([0-9]{{1,18}})\\s*$', 1)::bigint as key from (select id, unnest(from_json(chunks_json, '[{{"id":"VARCHAR"}}]')).id as c from projects where json_valid(chunks_json)) where regexp_matches(c, '^\\s*[A-Za-z]?[0-9]{{1,18}}\\s*$')),
gone as (select distinct record_table, record_id from tombstones),
orphans as (select ref_table, ref_id, ref_time, key::varchar as target_key, case when t.id is not null then 'late' when g.record_id is not null then 'deleted' else 'missing' end as reason
from to_questions r left join q_times t on t.id = r.key left join gone g on g.record_table = 'questions' and g.record_id = r.key where t.id is null or since > ref_time
union all select ref_table, ref_id, ref_time, 'c' || r.key, case when t.id is null and g.record_id is not null then 'deleted' when t.id is null or c.id is null then 'missing' else 'late' end
from to_chunks r left join p_times t on t.id = r.project_id left join there c on c.id = r.project_id and c.key = r.key left join gone g on g.record_table = 'projects' and g.record_id = r.project_id where t.id is null or c.id is null or since > ref_time)"""


def orphans() -> str:
    return f"with {_orphans()} select distinct ref_table, ref_id, target_key, reason from orphans"


def orphans_by_month() -> str:
    return f"with {_orphans()} select ref_table, strftime(make_timestamp(ref_time), '%Y-%m') as month, reason, count(*) as n_refs, count(distinct ref_id) as n_rows from (select distinct * from orphans) group by all"
