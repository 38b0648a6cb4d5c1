"""Projects, chats and messages: batches of requests against a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import constants as C
from palimpsest.functions import keys, scope as sc, text as tx
from palimpsest.operators.ordered import ordinal, top_per


def accessible_projects(projects: DataFrame, memberships: DataFrame) -> DataFrame:
    """Live projects with each member allowed to use them."""
    members = memberships.select("project_id", F.col("owner_id").alias("member_id"))
    return projects.where(F.col("archived_at").isNull()).join(members, "project_id")


def project_names(projects: DataFrame) -> DataFrame:
    """Lookup (owner, normalised name) -> project, live ones only."""
    return projects.where(F.col("archived_at").isNull()).select("owner_id", "normalized_name", "project_id", "name")


def resolve_projects(requests: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new projects, requests with their project).

    ``requests(request_id, owner_id, name, requested_at)``; blank names are left
    out.  The id of a new project follows from owner and name, so a retry makes
    the same one.
    """
    named = requests.withColumn("normalized_name", tx.name_key(F.col("name"))).where("normalized_name <> ''")
    known = projects.select("owner_id", "normalized_name", "project_id", F.col("name").alias("project_name"))
    missing = named.join(known, ["owner_id", "normalized_name"], "left_anti")
    first = top_per(missing, ["owner_id", "normalized_name"], [F.col("requested_at"), F.col("request_id")])
    created = first.select(
        keys.uuid5(F.concat_ws(":", F.lit("project"), "owner_id", "normalized_name")).alias("project_id"),
        "owner_id", tx.collapse(F.col("name")).alias("name"), "normalized_name",
        F.col("requested_at").alias("created_at"), F.col("requested_at").alias("updated_at"))
    everything = known.unionByName(created.select(
        "owner_id", "normalized_name", "project_id", F.col("name").alias("project_name")))
    return created, named.join(everything, ["owner_id", "normalized_name"])


def owner_memberships(created: DataFrame) -> DataFrame:
    return created.select("project_id", "owner_id", F.lit("owner").alias("role"), "created_at")


def _place(requests: DataFrame, projects: DataFrame, memberships: DataFrame) -> DataFrame:
    """Requests with the project they ask for, by id (members only) or by name."""
    by_id = accessible_projects(projects, memberships).select(
        F.col("project_id"), F.col("member_id").alias("owner_id"), F.col("name").alias("id_name")).distinct()
    by_name = projects.select("owner_id", "normalized_name", F.col("project_id").alias("name_project"),
                              F.col("name").alias("name_name"))
    asked = requests.withColumn("normalized_name", tx.name_key(F.coalesce("project_name", F.lit(""))))
    placed = asked.join(by_id, ["project_id", "owner_id"], "left").join(by_name, ["owner_id", "normalized_name"], "left")
    wants_id = F.coalesce("project_id", F.lit("")) != ""
    wants_name = ~wants_id & (F.col("normalized_name") != "")
    new_id = keys.uuid5(F.concat_ws(":", F.lit("project"), "owner_id", "normalized_name"))
    return placed.select(
        *[name for name in requests.columns if name not in ("project_id", "project_name")],
        (wants_id & F.col("id_name").isNull()).alias("refused"),
        F.when(wants_id, F.when(F.col("id_name").isNotNull(), F.col("project_id")))
        .when(wants_name, F.coalesce("name_project", new_id)).alias("project_id"),
        F.when(wants_id, F.col("id_name"))
        .when(wants_name, F.coalesce("name_name", tx.collapse(F.col("project_name")))).alias("project_scope"))


def create_sessions(requests: DataFrame, projects: DataFrame, memberships: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(new chats, refused requests)."""
    placed = _place(requests, projects, memberships)
    stamped = placed.withColumns({"created_at": sc.at(now), "updated_at": sc.at(now)})
    return stamped.where(~F.col("refused")).drop("refused"), placed.where("refused").drop("refused")


def move_sessions(sessions: DataFrame, moves: DataFrame, projects: DataFrame, memberships: DataFrame, now) -> DataFrame:
    """Chats after moving them to another project, or out of any; refused moves change nothing."""
    target = _place(moves, projects, memberships).where(~F.col("refused")).select(
        "session_id", "owner_id", F.col("project_id").alias("new_id"), F.col("project_scope").alias("new_scope"),
        F.lit(True).alias("moved"))
    joined = sessions.join(target, ["session_id", "owner_id"], "left")
    pick = lambda new, old: F.when(F.col("moved"), new).otherwise(F.col(old))
    return (joined.withColumns({"project_id": pick(F.col("new_id"), "project_id"),
                                "project_scope": pick(F.col("new_scope"), "project_scope"),
                                "updated_at": pick(sc.at(now), "updated_at")}).drop("new_id", "new_scope", "moved"))


def owned(df: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Rows asked for by their owner; a foreign owner finds nothing."""
    return df.join(asked.select(key, "owner_id"), [key, "owner_id"])


def next_turns(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg((F.max("turn_index") + 1).alias("next_turn"))


def append_messages(sessions: DataFrame, messages: DataFrame, incoming: DataFrame,
                    bucket: Column) -> tuple[DataFrame, DataFrame]:
    """(new messages with gapless turn indexes, chats with their activity time).

    ``bucket`` is a non-decreasing function of ``created_at``; it keeps one very
    busy chat from being ordered in a single task.
    """
    accepted = incoming.where(F.col("role").isin("user", "assistant")).join(
        sessions.select("session_id", "owner_id"), ["session_id", "owner_id"], "left_semi")
    last = messages.groupBy("session_id").agg(F.max("turn_index").alias("last_turn"))
    numbered = ordinal(accepted, ["session_id"], [F.col("created_at"), F.col("message_id")], bucket, "position")
    appended = (numbered.join(last, "session_id", "left")
                .withColumn("turn_index", (F.coalesce("last_turn", F.lit(0)) + F.col("position")).cast("int"))
                .drop("last_turn", "position"))
    activity = accepted.groupBy("session_id").agg(F.max("created_at").alias("active_at"))
    touched = (sessions.join(activity, "session_id", "left")
               .withColumn("updated_at", F.greatest("updated_at", "active_at")).drop("active_at"))
    return appended, touched


def set_titles(sessions: DataFrame, titles: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(chats with new titles, refused titles); only a default title is replaced."""
    clean = titles.withColumn("new_title", tx.collapse(F.col("title"))).drop("title")
    fits = F.length("new_title").between(1, C.STORED_TITLE_CHARS)
    joined = sessions.join(clean.where(fits), ["session_id", "owner_id"], "left")
    change = F.col("new_title").isNotNull() & (F.col("title") == C.DEFAULT_TITLE)
    return (joined.withColumn("updated_at", F.when(change, sc.at(now)).otherwise(F.col("updated_at")))
            .withColumn("title", F.when(change, F.col("new_title")).otherwise(F.col("title"))).drop("new_title"),
            clean.where(~fits))


def first_user_messages(messages: DataFrame) -> DataFrame:
    return top_per(messages.where(F.col("role") == "user"), ["session_id"], [F.col("turn_index")])


def backfill_titles(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Default-titled chats with the title that their first user message gives."""
    untitled = sessions.where(F.col("title") == C.DEFAULT_TITLE)
    wanted = messages.join(untitled.select("session_id"), "session_id", "left_semi")
    first = first_user_messages(wanted).select("session_id", F.col("content").alias("first_content"))
    return untitled.join(first, "session_id").withColumn("title", tx.title_from_message(F.col("first_content"))).drop("first_content")


def history(messages: DataFrame, sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """Messages of the chats asked for by their owner; order by ``turn_index`` when reading."""
    return messages.join(owned(sessions, asked, "session_id").select("session_id"), "session_id", "left_semi")


def backfill_session_projects(sessions: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects to create, chats with their project id) for chats that only know a name."""
    legacy = sessions.where(F.col("project_id").isNull() & (F.coalesce("project_scope", F.lit("")) != ""))
    requests = legacy.select(F.col("session_id").alias("request_id"), "owner_id", F.col("project_scope").alias("name"),
                             F.col("created_at").alias("requested_at"))
    created, resolved = resolve_projects(requests, projects)
    return created, resolved.select(F.col("request_id").alias("session_id"), "project_id", "project_name")


def upload_scopes(uploads: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uploads with their place, rejects with a reason)."""
    known = sessions.select("session_id", F.col("project_id").alias("chat_project"), F.lit(True).alias("found"))
    joined = uploads.join(known, "session_id", "left")
    reason = (F.when(F.col("found").isNull(), "session not found")
              .when((F.col("scope") == "project") & F.col("chat_project").isNull(), "project scope needs a project session"))
    to_project = F.col("scope") == "project"
    placed = joined.withColumn("reason", reason)
    good = placed.where(F.col("reason").isNull()).withColumns({
        "bound_session": F.when(~to_project, F.col("session_id")), "bound_project": F.when(to_project, F.col("chat_project"))})
    return good.drop("reason", "found", "chat_project"), placed.where(F.col("reason").isNotNull()).drop("found", "chat_project")
