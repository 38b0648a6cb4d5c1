"""Oracle-side SQL fragments shared by several statements."""

from palimpsest import constants as C
from palimpsest.plans.fixtures import NOW

B = r"[\s\p{Z}]+"


def collapse(x):
    return f"trim(regexp_replace({x}, '{B}', ' ', 'g'))"


def casefold(x):
    return f"replace(replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')"


def uuid5(name):
    h = f"sha1(unhex('{C.UUID_NAMESPACE_URL}') || encode({name}))"
    return (f"(SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||"
            f"CASE substr(h,17,1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' "
            f"WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' "
            f"WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END||substr(h,18,3)"
            f"||'-'||substr(h,21,12) FROM (SELECT {h} AS h))")


def valid_at(p="", now=NOW):
    return f"({p}valid_from <= TIMESTAMP '{now}' AND ({p}valid_to IS NULL OR {p}valid_to > TIMESTAMP '{now}'))"


def current(p="", now=NOW):
    return f"({p}status = 'active' AND {p}user_confirmed AND {valid_at(p, now)})"


def projectable(p="", now=NOW):
    return f"({p}scope IN ('session','project') AND {current(p, now)})"


def visible(r, q):
    """Authority rule: record ``r`` may be shown to chat ``q``."""
    return (f"({r}.owner_id = {q}.owner_id AND (({r}.scope = 'session' AND {r}.session_id = {q}.session_id)"
            f" OR ({r}.scope = 'project' AND {r}.project_id = {q}.project_id)"
            f" OR ({r}.scope = 'project' AND {r}.project_id IS NULL AND {r}.project_scope = {q}.project_scope)))")


def evidence_visible(b, q):
    return (f"({b}.owner_id = {q}.owner_id AND (({b}.scope = 'session' AND {b}.session_id = {q}.session_id)"
            f" OR ({b}.scope = 'project' AND {b}.project_id = {q}.project_id)))")


def ts(x):
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def scope_key(p=""):
    return (f"CASE WHEN {p}scope = 'session' THEN concat('session:', {p}session_id)"
            f" WHEN {p}scope = 'project' AND {p}project_id IS NOT NULL THEN concat('project:', {p}project_id)"
            f" WHEN {p}scope = 'project' THEN concat('project-name:', lower({p}project_scope)) ELSE {p}scope END")


def stable_ids(lst):
    return (f"list_transform(flatten(list_transform({lst}, lambda v: regexp_extract_all(lower(v), "
            r"'\b(?:[a-z]+[-_ ]?\d+[a-z\d]*|\d+[a-z]+|\d{2,})\b'))), lambda m: regexp_replace(m, '[^a-z0-9]', '', 'g'))")


def event_ids(p=""):
    return (f"CASE WHEN len({p}ev_refs) > 0 THEN list_sort(list_distinct(list_transform({p}ev_refs, lambda r: r.normalized_value)))"
            f" ELSE list_sort(list_distinct({stable_ids(p + 'ev_entities')})) END")


def domain(p=""):
    return (f"concat_ws(chr(31), {p}owner_id, {p}scope, CASE WHEN {p}scope = 'session' THEN {p}session_id ELSE '' END,"
            f" coalesce({p}project_id, {p}project_scope, ''))")


def identity(p=""):
    return (f"sha256(concat_ws(chr(31), {domain(p)}, array_to_string(CASE WHEN len({p}ev_refs) > 0 THEN"
            f" list_sort(list_transform({p}ev_refs, lambda r: r.normalized_value)) ELSE list_sort(list_distinct({stable_ids(p + 'ev_entities')})) END, '|'),"
            f" CASE WHEN len({p}ev_claims) > 0 THEN array_to_string(list_sort(list_transform({p}ev_claims, lambda c:"
            f" concat(trim(lower(c.attribute)), '=', c.normalized_value))), '|')"
            f" ELSE concat('temporal_scope=', lower(coalesce({p}ev_time, '')), '|locations=', lower({p}ev_locations[1])) END))")


def claims(p=""):
    """Claims of an event as a map attribute -> value."""
    return (f"CASE WHEN len({p}ev_claims) > 0 THEN map_from_entries(list_transform({p}ev_claims, lambda c:"
            f" struct_pack(k := trim(lower(c.attribute)), v := c.value)))"
            f" WHEN {p}ev_time IS NOT NULL THEN map_from_entries([struct_pack(k := 'temporal_scope', v := {p}ev_time),"
            f" struct_pack(k := 'primary_location', v := {p}ev_locations[1])])"
            f" ELSE map_from_entries([struct_pack(k := 'primary_location', v := {p}ev_locations[1])]) END")


def differences(a, b):
    """Text form of the claim differences between two claim maps."""
    return (f"array_to_string(list_transform(list_filter(list_sort(list_distinct(list_concat(map_keys({a}), map_keys({b})))),"
            f" lambda k: {a}[k] IS DISTINCT FROM {b}[k]), lambda k: concat(k, ':', coalesce({a}[k], ''), '>', coalesce({b}[k], ''))), ';')")


def memory_text(p=""):
    return (f"CASE {p}kind WHEN 'knowledge' THEN concat({p}know_subject, ' ', {p}know_predicate, ' ', {p}know_object, '.')"
            f" WHEN 'preference' THEN concat('The user prefers ', {p}pref_behavior, '.', CASE WHEN len({p}pref_conditions) > 0"
            f"  THEN concat(' Applicable when: ', array_to_string({p}pref_conditions, ', '), '.') ELSE '' END)"
            f" WHEN 'solution' THEN concat('Problem: ', {p}sol_problem, '. Environment: os=v', {p}k % 3, '. Steps: ',"
            f"  array_to_string({p}sol_steps, '; '), '. Outcome: ', coalesce({p}sol_outcome, 'not specified'), '.')"
            f" WHEN 'entity' THEN concat('Entity: ', {p}ent_name, '. Type: ', {p}ent_type, '. Aliases: ', array_to_string({p}ent_aliases, ', '), '.')"
            f" ELSE concat('Project event (', replace(lower({p}ev_type_raw), ' ', '_'), '): ', {p}ev_summary, '. Entities: ',"
            f"  array_to_string({p}ev_entities, ', '), '. Locations: ', array_to_string({p}ev_locations, ', '), '.',"
            f"  CASE WHEN {p}ev_time IS NOT NULL THEN concat(' Timing: ', {p}ev_time, '.') ELSE '' END,"
            f"  CASE WHEN len({p}ev_refs) > 0 THEN concat(' Identifiers: ', array_to_string(list_transform({p}ev_refs, lambda r: r.value), ', '), '.') ELSE '' END,"
            f"  CASE WHEN len({p}ev_claims) > 0 THEN concat(' Current explicit values: ', array_to_string(list_transform({p}ev_claims,"
            f"   lambda c: concat(c.attribute, '=', c.value)), '; '), '.') ELSE '' END) END")
