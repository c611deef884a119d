"""Recommendations for all students and queries of one run.

What depends on the request alone (which courses it may mean, what rejects
them, their scores) is worked out once for each distinct request, as a list of
courses. Students go down the list of their request with all that shuts them
out of courses in one row, so a pair of a student and a course is tested where
it is made, and only counts and the best go further.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import fixed, text
from almanac.operators import policy, schedule
from almanac.operators.rounds import settled, shared_folder
from almanac.operators.sequence import first_wins, spread

STRICT = {"no_attendance": ("attendance_required", "no attendance requirement"), "no_midsem": ("has_midsem", "no mid-semester exam"), "no_compre": ("has_compre", "no comprehensive exam")}
HARD = ["no_attendance", "no_quiz", "no_midsem", "no_compre", "project_based", "open_book"]
#: ln(1 + 5) / 10, part of every score.
REVIEW_BONUS = 0.1791759469228055


def limited(limit: int) -> int:
    return max(1, min(limit, fixed.MOST_RESULTS))


def keyword_score(wanted: Column, title: Column, descriptive: Column) -> Column:
    """5 for a wanted token in the title, 3 for one only in the description."""
    in_title = F.array_intersect(wanted, title)
    anywhere = F.array_intersect(wanted, descriptive)
    return F.size(in_title) * 5.0 + F.size(F.array_except(anywhere, in_title)) * 3.0


def matched(rows: DataFrame) -> DataFrame:
    """Add the outcome of every preference to rows.

    Rows hold ``p`` (preferences), interests and the course's title, units,
    description tokens and handout facts. Added: rejected, score, matches,
    unknown and claims.
    """
    p = F.col("p")
    handout = F.coalesce("has_handout", F.lit(False))
    wanted = F.array_union(p["keywords"], F.col("interest_tokens"))
    found = F.sort_array(F.array_intersect(wanted, F.col("descriptive_tokens")))
    rejects: list[Column] = []
    points: list[Column] = [keyword_score(wanted, F.col("title_tokens"), F.col("descriptive_tokens"))]
    matches: list[Column] = [F.when(F.size(found) > 0, F.concat(F.lit("matches "), F.array_join(F.slice(found, 1, 5), ", ")))]
    unknown: list[Column] = []
    claims: list[Column] = []

    def add(asked: Column, holds: Column, score: Column | float, says: Column, source: Column | None = None, otherwise: str = "reject") -> None:
        yes = asked & F.coalesce(holds, F.lit(False))
        points.append(F.when(yes, score).otherwise(0.0))
        matches.append(F.when(yes, says))
        if otherwise == "reject":
            rejects.append(asked & ~F.coalesce(holds, F.lit(False)))
        if source is not None:
            claims.append(F.when(yes, F.struct(says.alias("claim"), F.lit("supported").alias("status"), source.alias("source"))))

    def row(first: str) -> Column:
        return F.concat_ws("#", "source_file", F.concat(F.lit("row "), F.col(first)))

    for flag, (fact, label) in STRICT.items():
        actual = F.when(handout, F.col(fact))
        add(p[flag], actual.eqNullSafe(F.lit(False)), 6.0, F.lit(f"{label} is explicitly supported"), F.concat_ws("#", "source_file", F.lit(fact)))
        unknown.append(F.when(p[flag] & actual.isNull(), F.lit(label)))
    whole = handout & F.coalesce("sums_to_100", F.lit(False))
    add(p["low_midsem"], F.col("midsem_weight").isNotNull(), F.greatest(F.lit(0.0), 40 - F.col("midsem_weight")) / 4, F.concat(F.lit("midsem weight is "), text.number(F.col("midsem_weight")), F.lit("%")))
    quizzes = F.coalesce("quiz_count", F.lit(0))
    plural = F.when(quizzes == 1, "").otherwise("s")
    add(p["fewer_quizzes"], whole, F.greatest(F.lit(0), 5 - quizzes).cast("double"), F.concat(quizzes.cast("string"), F.lit(" listed quiz component"), plural))
    add(p["high_project_weight"], F.col("project_weight") > 0, F.col("project_weight") / 5, F.concat(F.lit("project weight is "), text.number(F.col("project_weight")), F.lit("%")))
    add(p["low_exam_weight"], F.col("n_components") > 0, F.greatest(F.lit(0.0), 100 - F.coalesce("exam_weight", F.lit(0.0))) / 10, F.concat(F.lit("listed exam weight is "), text.number(F.coalesce("exam_weight", F.lit(0.0))), F.lit("%")))
    rejects.append(p["lenient_makeup"])  # leniency cannot be verified
    unknown.append(F.when(p["lenient_makeup"], F.lit("makeup-policy leniency")))
    quiz_seen = F.coalesce("mentions_quiz", F.lit(False))
    complete = whole & F.coalesce(F.col("extraction_status") == "extracted_unverified", F.lit(False))
    add(p["no_quiz"], ~quiz_seen & complete, 6.0, F.lit("no quiz component is listed in the complete evaluation scheme"), F.concat_ws("#", "source_file", F.lit("evaluation_components")))
    unknown.append(F.when(p["no_quiz"] & ~quiz_seen & ~complete, F.lit("quiz-free evaluation")))
    add(p["project_based"], F.col("project_listed"), 5.0, F.lit("project evaluation is listed"), row("project_row"))
    add(p["open_book"], F.col("open_book_listed"), 4.0, F.lit("an open-book component is listed"), row("open_book_row"))
    policy_text = handout & F.coalesce("has_makeup_policy", F.lit(False))
    add(p["makeup_requested"], policy_text, 1.0, F.lit("make-up policy text is available for review"), otherwise="unknown")
    soft = F.when(p["makeup_requested"] & ~policy_text, F.lit("make-up policy"))
    add(F.col("n_feasible") > 0, F.lit(True), 2.0, F.lit("a clash-free listed section is available"), F.lit("timetable"), otherwise="none")
    rejects.append((F.col("n_timed") > 0) & (F.col("n_feasible") == 0))
    idle = (F.size(wanted) == 0) & ~reduce(lambda a, b: a | b, [p[f] for f in HARD])
    points.append(F.when(idle, 1.0).otherwise(0.0))
    total = reduce(lambda a, b: a + b, points) + REVIEW_BONUS
    return rows.select(
        "*", reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(False)) for r in rejects]).alias("rejected"), F.round(total, 2).alias("score"),
        F.array_compact(F.array(*matches)).alias("matches"), F.array_compact(F.array(*unknown)).alias("unknown"),
        F.array_compact(F.array(soft)).alias("soft_unknown"), F.array_compact(F.array(*claims)).alias("claims"),
    )


def handout_facts(handouts: DataFrame, components: DataFrame) -> DataFrame:
    """Per course (first handout wins): the facts that preferences ask about.

    ``handouts`` (doc_id, ordinal, course_codes, description, scope, topics:
    array of text, attendance_required, has_midsem, has_compre, makeup_policy,
    sums_to_100, extraction_status, source_file), ``components`` (doc_id,
    row_number, name, type, weight, marks, count, book_policy, raw_text).
    """
    from almanac.operators.quality import component_sums

    sums = component_sums(components)
    quiz = r"(?i)\bquiz(?:zes|es|z)?\b"
    project = (F.col("type") == "project") | F.contains(F.lower("name"), F.lit("project"))
    opens = F.col("book_policy").isin("open", "partly_open", "mixed")
    seen = components.groupBy("doc_id").agg(
        F.max((F.col("type") == "quiz") | F.regexp_like(F.concat_ws(" ", "name", "raw_text"), F.lit(quiz))).alias("mentions_quiz"),
        F.max(project).alias("project_listed"), F.coalesce(F.max(opens), F.lit(False)).alias("open_book_listed"),
        F.min(F.when(project, F.col("row_number"))).alias("project_row"), F.min(F.when(opens, F.col("row_number"))).alias("open_book_row"),
    )
    per_course = first_wins(handouts.withColumn("course", F.explode("course_codes")), ["course"], ["ordinal"])
    return per_course.join(sums, "doc_id", "left").join(seen, "doc_id", "left").select(
        "course", F.lit(True).alias("has_handout"), F.concat_ws(" ", F.nullif("description", F.lit("")), F.nullif("scope", F.lit("")), F.array_join("topics", " ")).alias("described"),
        "attendance_required", "has_midsem", "has_compre", (F.coalesce("makeup_policy", F.lit("")) != "").alias("has_makeup_policy"), "sums_to_100", "extraction_status", "source_file",
        "n_components", "midsem_weight", "quiz_count", "project_weight", "exam_weight", "mentions_quiz", "project_listed", "open_book_listed", "project_row", "open_book_row",
    )


def prepared(tables: dict[str, DataFrame], requests: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """``tables`` with ``courses``, one row for every course on offer with all its facts, and the requests with their students; what several steps read is derived once."""
    t = tables
    offerings = t["offerings"]
    chosen = first_wins(offerings.where(~F.col("cancelled")), ["course"], ["ordinal"])
    courses = (
        chosen.select("course", "computer_code", "midsem", "compre", F.col("u").alias("offered_u"), F.col("title").alias("offered_title"), F.col("restricted").alias("chosen_restricted"))
        .join(policy.offered(offerings), "course").join(t["catalogue"].select("course", F.col("title").alias("listed_title"), "units", "prerequisite_expression", "needs"), "course", "left")
        .join(t["facts"], "course", "left")
        .where("NOT (coalesce(prerequisite_expression, '') <> '' AND coalesce(size(needs), 0) <= 0)")
        .withColumn("title", F.coalesce(F.nullif("offered_title", F.lit("")), F.nullif("listed_title", F.lit("")), F.col("course").cast("string")))
        .withColumn("load", F.coalesce(F.nullif("offered_u", F.lit(0)), F.nullif("units", F.lit(0)), F.lit(0)))
        .withColumn("title_tokens", text.tokens(F.col("title")))
        .withColumn("descriptive_tokens", text.tokens(F.concat_ws(" ", "title", "described")))
    )
    asked = requests.join(t["students"], "student").withColumn("interest_tokens", F.coalesce(text.tokens(F.array_join("interests", " ")), F.array().cast("array<string>")))
    return t | {"courses": settled(courses), "completed": settled(t["completed"]), "current": settled(t["current"])}, settled(asked)


#: Courses of a list that a task holds at once, and the places up to which the best are looked for first.
BLOCK, LEVELS = 16384, [64, 512, 4096]


def part(place: Column, levels: list[int]) -> Column:
    """The part of a list that a place is in, from 0."""
    return reduce(lambda a, b: a + b, [(place > n).cast("int") for n in levels], F.floor((place - 1) / BLOCK).cast("int"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` as packed columns in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/lists-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def named(asked: DataFrame, *by: str) -> DataFrame:
    """``asked`` with ``request``, one of the students who ask for the same ``by``."""
    return asked.withColumn("request", F.min("student").over(Window.partitionBy(*by)))


def listed(courses: DataFrame, asked: DataFrame, *by: str) -> DataFrame:
    """The courses that share a keyword with each distinct request, or all for one without keywords, with the facts of both."""
    requests = asked.where(F.col("student") == F.col("request")).select("request", *by)
    with_words = requests.where("size(p.keywords) > 0").select("request", F.explode("p.keywords").alias("token"))
    pairs = with_words.join(courses.select("course", F.explode("descriptive_tokens").alias("token")), "token").select("request", "course").distinct()
    every = requests.where("size(p.keywords) = 0").select("request").crossJoin(courses.select("course"))
    return pairs.unionByName(every).join(requests, "request").join(courses, "course")


def screened(t: dict[str, DataFrame], exams: schedule.Exams) -> DataFrame:
    """The courses on offer with all that decides which students they are open to."""
    programmes = [F.collect_set(F.when(F.col("category") == c, F.col("programme"))).alias(f"{c.lower()}_of") for c in ("CDC", "DEL")]
    groups = t["groups"].groupBy("course").agg(F.collect_set("group").alias("groups")).select("course", F.get("groups", F.lit(0)).alias("group"), F.when(F.size("groups") > 1, F.col("groups")).alias("groups"))
    rows = t["courses"].join(exams.of_courses(), "course", "left").join(groups, "course", "left").join(t["categories"].groupBy("course").agg(*programmes), "course", "left")
    rows = rows.join(t["humanities"].select("course").distinct().withColumn("is_huel", F.lit(True)), "course", "left")
    return rows.withColumn("restricted", F.col("all_restricted") | F.col("chosen_restricted")).withColumn("needy", F.coalesce(F.size("needs") > 0, F.lit(False)))


SCREEN = ["course", "restricted", "load", *(f"exam_{n}{i}" for i in (0, 1) for n in ("word", "bit")), "group", "groups", "needy", "cdc_of", "del_of", "is_huel"]


def bound(t: dict[str, DataFrame], asked: DataFrame, exams: schedule.Exams) -> DataFrame:
    """``asked`` with all that shuts a student out of courses: one row for each, however many courses there are."""
    done = t["completed"].distinct()
    needs = t["courses"].where("size(needs) > 0").withColumn("_all", F.array_distinct("needs")).select("course", F.size("_all").alias("_n"), F.explode("_all").alias("needs"))
    met = done.withColumnRenamed("course", "needs").join(needs, "needs").groupBy("student", "course", "_n").agg(F.count("*").alias("_met")).where("_met = _n")
    due = {f"{c.lower()}_due": F.max((F.col("category") == c) & (F.col("remaining") > 0)) for c in ("DEL", "HUEL")}
    facts = [
        t["completed"].unionByName(t["current"]).groupBy("student").agg(F.collect_set("course").alias("taken")),
        policy.done_in_groups(t["groups"], done).groupBy("student").agg(F.collect_set("group").alias("done_groups")),
        met.groupBy("student").agg(F.collect_set("course").alias("met")), exams.of_students(),
        t["progress"].groupBy("student").agg(*(v.alias(n) for n, v in due.items())),
    ]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    rows = asked.join(together.groupBy("student").agg(*(F.first(c, ignorenulls=True).alias(c) for c in together.columns if c != "student")), "student", "left")
    most = policy.unit_limit(F.col("degree_level")) - F.coalesce("existing_units", F.lit(0))
    return rows.withColumns({"most": most, "newcomer": F.col("admission_year").eqNullSafe(F.lit(fixed.RESTRICTED_YEAR)), "category": F.col("p.category")})


BOUND = ["student", "request", "programme", "category", "most", "newcomer", "taken", "done_groups", "met", "busy_exams", "del_due", "huel_due"]


def eligible() -> Column:
    """Whether a row of ``bound`` and one of ``screened`` go together, by built-ins that Spark compiles; what costs little comes first."""
    def yes(c: Column | str) -> Column:
        return F.coalesce(c, F.lit(False))

    core, elective = (yes(F.array_contains(c, F.col("programme"))) for c in ("cdc_of", "del_of"))
    kind, pool = F.col("category"), yes("is_huel")
    free = ~(core | (elective & yes("del_due")) | (pool & yes("huel_due")))
    verified = F.when(kind.isNull(), True).when(kind == "cdc", core).when(kind == "del", elective).when(kind == "huel", pool).when(kind == "opel", free).otherwise(False)
    equivalent = yes(F.array_contains("done_groups", F.col("group"))) | yes(F.arrays_overlap("done_groups", "groups"))
    able = ~F.col("needy") | yes(F.array_contains("met", F.col("course")))
    return (F.col("load") <= F.col("most")) & (F.col("newcomer") | ~F.col("restricted")) & schedule.Exams.free() & verified & able & ~yes(F.array_contains("taken", F.col("course"))) & ~equivalent


def going_down(asked: DataFrame, lists: DataFrame, parts: DataFrame, which: Column, tasks: int | None) -> DataFrame:
    """Rows of ``asked`` with rows of the same request and ``part`` of ``lists``, dealt to ``tasks``; ``parts`` (keys of asked, last), of which ``which`` are looked at."""
    wide = asked.join(parts, [c for c in parts.columns if c != "last"]).withColumn("part", F.explode(which)).drop("last")
    n = tasks or int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread(wide, n, "request", "part").join(spread(lists, n, "request", "part").hint("shuffle_hash"), ["request", "part"])


def unknown_facts(t: dict[str, DataFrame], asked: DataFrame, tasks: int | None = None) -> DataFrame:
    """(student, label, n): how many candidates lack a fact that is asked about. Only requests that ask for such facts meet courses, only such courses as lack them, and no section is looked at."""
    p = F.col("p")
    about = reduce(lambda a, b: a | b, [p[f] for f in [*STRICT, "lenient_makeup", "no_quiz"]])
    exams = schedule.Exams(t["courses"], t["current"], t["offerings"])
    asked = named(asked.where(about), "p")
    rows = listed(screened(t, exams), asked, "p").withColumns({"n_feasible": F.lit(0), "n_timed": F.lit(0), "interest_tokens": F.array().cast("array<string>")})
    place = F.row_number().over(Window.partitionBy("request").orderBy("course"))
    lacking = matched(rows).where(F.size("unknown") > 0).select("request", *SCREEN, "unknown").withColumn("part", part(place, []))
    lists = stored(lacking)
    last = lists.groupBy("request").agg(F.max("part").alias("last"))
    pairs = going_down(bound(t, asked, exams).select(*BOUND), lists, last, F.sequence(F.lit(0), F.col("last")), tasks).where(eligible())
    # Counts come first by what is unknown as a whole, as no row is made for a pair and a label.
    counts = pairs.groupBy("student", "unknown").agg(F.count("*").alias("n"))
    return counts.select("student", F.explode("unknown").alias("label"), "n").groupBy("student", "label").agg(F.sum("n").alias("n"))


def best(t: dict[str, DataFrame], asked: DataFrame, limit: int = fixed.DEFAULT_RESULTS, tasks: int | None = None) -> DataFrame:
    """Each request's best candidates with their evidence, which is written for them only.

    All pairs that a list allows are tested once for the count of each part of
    the list, and once more down to the part in which a student's last answer is.
    """
    kind, k = F.col("p.category"), limited(limit)
    exams, meetings = schedule.Exams(t["courses"], t["current"], t["offerings"]), schedule.Meetings(t["sections"], t["current"])
    asked = named(asked.where(~F.coalesce("p.lenient_makeup", F.lit(False))), "p", "interest_tokens")  # leniency rejects every course
    rows = listed(screened(t, exams).join(meetings.of_courses(), "course", "left"), asked, "p", "interest_tokens")
    # A candidate has a section that fits, or none that is listed, so the score is the same for all who ask the same.
    scored = matched(rows.withColumns({"n_feasible": F.coalesce("has_section", F.lit(False)).cast("int"), "n_timed": F.lit(0)})).where("NOT rejected")
    narrow = scored.select("request", *SCREEN, "has_section", "untimed", "single", "more", "score")
    place = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "course"))
    lists = stored(narrow.withColumn("place", place).withColumn("part", part(F.col("place"), LEVELS)).drop("score"))
    facts = lists.agg(F.max(F.size("more"))).first()
    test = eligible() & meetings.open(facts[0] or 0)
    students = stored(meetings.closed(bound(t, asked, exams), F.col("p.free_day"), F.col("p.no_early_classes")).select(*BOUND, "closed"))
    last = lists.groupBy("request").agg(F.max("part").alias("last"))
    counts = going_down(students, lists, last, F.sequence(F.lit(0), F.col("last")), tasks).where(test).groupBy("student", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("student").orderBy("part")
    reached = counts.withColumn("_before", F.sum("n").over(upto) - F.col("n"))
    totals = stored(reached.groupBy("student").agg(F.sum("n").alias("eligible_candidates"), F.max(F.when(F.col("_before") < k, F.col("part"))).alias("last")))
    found = going_down(students, lists, totals.select("student", "last"), F.sequence(F.lit(0), F.col("last")), tasks).where(test).select("student", "course", "place")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("student").orderBy("place"))).where(F.col("rank") <= k).drop("place")
    wanted = asked.select("student", F.col("p.free_day").alias("_free"), F.col("p.no_early_classes").alias("_no_early"))
    fitted = meetings.fitting(ranked.join(wanted, "student"), F.col("_free"), F.col("_no_early")).drop("_free", "_no_early").join(totals.drop("last"), "student")
    chosen = matched(fitted.join(t["courses"], "course").join(asked, "student"))
    eligibility = F.array_compact(F.array(
        F.lit("offered this semester"), F.when(F.size("needs") > 0, "explicit prerequisites completed"),
        F.when(kind.isNotNull(), F.concat(F.lit("verified "), F.upper(kind), F.lit(" for "), F.col("programme"))),
    ))
    return chosen.select(
        "student", "course", text.title_case(F.col("title")).alias("title"), F.col("offered_u").alias("units"), "computer_code", "score", F.upper(kind).alias("requirement"),
        eligibility.alias("eligibility"), F.when(F.size("matches") > 0, F.col("matches")).otherwise(F.array(F.lit("eligible current offering"))).alias("matches"),
        F.concat("unknown", "soft_unknown").alias("manual_review"), "claims", "sections", "rank", "eligible_candidates",
    )


def recommend(tables: dict[str, DataFrame], requests: DataFrame, limit: int = fixed.DEFAULT_RESULTS) -> tuple[DataFrame, DataFrame]:
    """(recommendations, unknown facts) for ``requests`` (student, query, p: preferences).

    ``tables``: students (student, programme, degree_level, admission_year,
    existing_units, interests: array), completed and current (student,
    course), catalogue (course, title, units, prerequisite_expression, needs),
    offerings (course, computer_code, title, u, cancelled, restricted, midsem,
    compre, ordinal), sections (course, section, room, meeting_text, ordinal),
    groups (group, course), categories (programme, category, course),
    humanities (course), facts (see ``handout_facts``), progress (see
    ``requirements.progress``).
    """
    t, asked = prepared(tables, requests)
    return best(t, asked, limit), unknown_facts(t, asked)
