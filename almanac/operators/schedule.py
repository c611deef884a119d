"""Timetable operators: exam slots, occupied slots, feasible sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import text
from almanac.operators.rounds import settled


#: Slots in a word of a mask.
BITS = 62


class Calendar:
    """The distinct slots of a term with their numbers: as many as its days and sessions, however many courses there are."""

    def __init__(self, slots: DataFrame):
        name = slots.columns[0]
        self.slots, self.name = settled(slots.distinct()), name
        self.n = self.slots.count()
        numbered = self.slots.select(name, (F.row_number().over(Window.orderBy(name)) - 1).alias("_slot"))
        self.numbers = settled(numbered)
        self.words = [f"w{i}" for i in range(max(1, -(-self.n // BITS)))]

    def number(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the number of their slot in ``_slot`` in place of the slot."""
        known = self.numbers.withColumnRenamed(self.name, "_known")
        return rows.join(F.broadcast(known), rows[self.name].eqNullSafe(F.col("_known"))).drop(self.name, "_known")

    def masks(self, rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
        """(keys, w0, w1, ..., more): the slots of all rows of a key as bits of some words."""
        return self.number(rows).groupBy(*keys).agg(*self.words_of("_slot"), *more)

    def words_of(self, slot: str) -> list[Column]:
        """Aggregates: the slots with the numbers in that column as bits of words."""
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(slot) % BITS)
        return [F.bit_or(F.when(F.floor(F.col(slot) / BITS) == i, bit).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(self.words)]

    def held(self, current: DataFrame, per_course: DataFrame) -> DataFrame:
        """(student, busy): the masks of all current courses of a student as one struct of words."""
        rows = current.select("student", "course").distinct().join(per_course.select("course", *self.words), "course")
        return rows.groupBy("student").agg(*(F.bit_or(w).alias(w) for w in self.words)).select("student", F.struct(F.lit(True).alias("any"), *self.words).alias("busy"))

    def has(self, busy: Column, slot: Column) -> Column:
        """Whether the mask has the slot of that number."""
        word = reduce(lambda rest, x: F.when(F.floor(slot / BITS) == x[0], busy[x[1]]).otherwise(rest), enumerate(self.words), F.lit(0).cast("long"))
        return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), slot % BITS)) != 0

    def meet(self, busy: Column, other: Column) -> Column:
        """Whether two structs of words have a slot in common."""
        return reduce(lambda a, w: a | (busy[w].bitwiseAND(other[w]) != 0), self.words, F.lit(False))


def exams(offerings: DataFrame) -> DataFrame:
    """(course, exam): the exam slots that rows of ``offerings`` (course, midsem, compre) state, as texts of kind, date and session."""
    def one(kind: str):
        e = F.col(kind)
        return F.when(e["date"].isNotNull(), F.concat_ws("|", F.lit(kind), e["date"], F.coalesce(e["session"], F.lit(""))))

    return offerings.select("course", F.explode(F.array_compact(F.array(one("midsem"), one("compre")))).alias("exam"))


class Exams:
    """Exam clashes: the slots of ``chosen`` offerings against those of all ``offerings`` of a student's current courses."""

    def __init__(self, chosen: DataFrame, current: DataFrame, offerings: DataFrame):
        self.calendar = Calendar(exams(offerings).select("exam"))
        number = self.calendar.number
        self.wanted = number(exams(chosen)).groupBy("course").agg(F.collect_set("_slot").alias("exams"))
        self.busy = self.calendar.held(current, self.calendar.masks(exams(offerings), ["course"]))

    def without_clash(self, pairs: DataFrame) -> DataFrame:
        """(student, course) pairs of which no exam slot is taken."""
        rows = pairs.join(self.wanted, "course", "left").join(self.busy, "student", "left")
        clash = F.exists("exams", lambda e: self.calendar.has(F.col("busy"), e))
        return rows.where(~F.coalesce(clash, F.lit(False))).select(*pairs.columns)

    def of_courses(self) -> DataFrame:
        """(course, exam_words, exam_bits): where the at most two exam slots of a chosen offering are in ``of_students``."""
        words = F.transform("exams", lambda e: F.floor(e / BITS).cast("int"))
        bits = F.transform("exams", lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), (e % BITS).cast("int")))
        return self.wanted.select("course", words.alias("w"), bits.alias("b")).select("course", *(F.get(c, F.lit(i)).alias(f"exam_{n}{i}") for i in (0, 1) for c, n in (("w", "word"), ("b", "bit"))))

    def of_students(self) -> DataFrame:
        """(student, busy_exams): the slots that current courses take as an array of words."""
        return self.busy.select("student", F.array(*(F.col("busy")[w] for w in self.calendar.words)).alias("busy_exams"))

    @staticmethod
    def free() -> Column:
        """Whether no exam of ``of_courses`` is in a slot of ``of_students``, by built-ins that Spark compiles, for joins that make many pairs."""
        return reduce(lambda a, b: a & b, [F.coalesce(F.get("busy_exams", F.col(f"exam_word{i}")).bitwiseAND(F.col(f"exam_bit{i}")), F.lit(0).cast("long")) == 0 for i in (0, 1)])


def feasible_counts(pairs: DataFrame, offerings: DataFrame, current: DataFrame, unwanted: Column) -> DataFrame:
    """(student, course, n_timed, n_feasible): the sections of each pair's course, and those beside the student's current ones without an ``unwanted`` slot.

    ``offerings`` (course, computer_code, slot); all that states a slot counts as timed. A course's sections stay one row, and a
    student's slots are a few words, so no row is made for a pair and a section.
    """
    slots = offerings.select("course", "computer_code", "slot")
    calendar = Calendar(slots.select("slot"))
    sections = calendar.masks(slots.withColumn("_out", unwanted), ["course", "computer_code"], F.coalesce(F.bool_or("_out"), F.lit(False)).alias("_out"))
    words = F.struct(F.lit(True).alias("any"), *calendar.words)
    per_course = sections.groupBy("course").agg(
        F.count("*").alias("n_timed"), F.collect_list(F.when(~F.col("_out"), words)).alias("open"), *(F.bit_or(w).alias(w) for w in calendar.words),
    )
    rows = pairs.join(calendar.held(current, per_course), "student", "left").join(per_course.select("course", "n_timed", "open"), "course")
    free = F.size(F.filter("open", lambda s: ~F.coalesce(calendar.meet(F.col("busy"), s), F.lit(False))))
    return rows.select("student", "course", "n_timed", free.cast("long").alias("n_feasible"))


class Meetings:
    """Clashes of meetings: a section is one mask, a course one row with its sections in order, and a request one mask of the slots that it cannot use."""

    def __init__(self, sections: DataFrame, current: DataFrame):
        # A meeting text is parsed once, however many sections have it.
        slots = sections.where("meeting_text IS NOT NULL").select("meeting_text").distinct().select("meeting_text", F.explode(text.meeting_slots(F.col("meeting_text"))).alias("slot"))
        slots = settled(slots)
        self.calendar = calendar = Calendar(slots.select("slot"))
        known = sections.join(calendar.masks(slots, ["meeting_text"]), "meeting_text", "left")
        timed = F.col(calendar.words[0]).isNotNull()
        listed = F.struct("ordinal", "section", "room", F.col("meeting_text").alias("meeting"), F.struct(F.lit(True).alias("any"), *(F.coalesce(w, F.lit(0).cast("long")).alias(w) for w in calendar.words)).alias("slots"))
        self.per_course = known.groupBy("course").agg(F.count_if(timed).alias("n_timed"), F.array_sort(F.collect_list(listed)).alias("_all"), *(F.bit_or(w).alias(w) for w in calendar.words))
        self.held = calendar.held(current, self.per_course.where("n_timed > 0"))

    def closed(self, rows: DataFrame, free_day: Column, no_early: Column) -> DataFrame:
        """Add ``closed``, the slots that a row (student) cannot use as one mask: those held, those of the ``free_day``, and the first period with ``no_early``."""
        c = self.calendar
        rows = rows.withColumns({"_day": free_day, "_early": F.coalesce(no_early, F.lit(False))})
        kinds = F.explode(F.array(F.struct(F.col("slot.day").alias("_day"), F.lit(False).alias("_only")), F.struct(F.lit(None).cast("string").alias("_day"), F.lit(True).alias("_only"))))
        bits = c.numbers.select("_slot", F.col("slot.period").alias("period"), kinds.alias("k")).select("_slot", "k._day", "k._only", "period").where("NOT _only OR period = 1")
        unwanted = bits.groupBy("_day").agg(*c.words_of("_slot"))
        day = F.broadcast(unwanted.where("_day IS NOT NULL").select("_day", F.struct(*c.words).alias("_off")))
        early = F.broadcast(unwanted.where("_day IS NULL").select(F.lit(True).alias("_early"), F.struct(*c.words).alias("_first")))
        rows = rows.join(day, "_day", "left").join(early, "_early", "left").join(self.held, "student", "left")
        none = F.lit(0).cast("long")
        out = F.struct(*(reduce(lambda a, b: a.bitwiseOR(b), [F.coalesce(F.col(m)[w], none) for m in ("busy", "_off", "_first")]).alias(w) for w in c.words))
        return rows.withColumn("closed", out).drop("_day", "_early", "_off", "_first", "busy")

    def of_courses(self) -> DataFrame:
        """(course, has_section, untimed, single, more): all that decides whether a course has a section beside a mask.

        That is a section without a slot, the slots that sections of one slot
        have, as one mask, and the masks of other sections, but for those that
        hold such a slot: where they fit, that section fits.
        """
        words = self.calendar.words
        masks = F.array_distinct(F.transform("_all", lambda s: s["slots"]))
        size = lambda m: reduce(lambda a, b: a + b, [F.bit_count(m[w]) for w in words])
        alone = F.filter("_masks", lambda m: size(m) == 1)
        zero = F.lit(0).cast("long")
        either = lambda w: F.aggregate("_alone", zero, lambda a, m: a.bitwiseOR(m[w]))
        single = F.struct(*(either(w).alias(w) for w in words))
        rows = self.per_course.select("course", masks.alias("_masks")).withColumn("untimed", F.exists("_masks", lambda m: size(m) == 0)).withColumn("_alone", alone).withColumn("single", single)
        more = F.filter("_masks", lambda m: ~F.col("untimed") & (size(m) > 1) & ~self.calendar.meet(F.col("single"), m))
        return rows.select("course", F.lit(True).alias("has_section"), "untimed", "single", more.alias("more"))

    def open(self, most: int) -> Column:
        """Whether a course (see ``of_courses``; at most that many in ``more``) has a section beside the ``closed`` slots, or none is listed."""
        def beside(mask: Column) -> Column:
            return mask.isNotNull() & ~self.calendar.meet(F.col("closed"), mask)

        some = reduce(lambda a, w: a | (F.col("single")[w].bitwiseAND(F.bitwise_not(F.col("closed")[w])) != 0), self.calendar.words, F.lit(False))
        # A few masks are written out, as Spark compiles no higher-order function.
        rest = reduce(lambda a, i: a | beside(F.get("more", F.lit(i))), range(most), F.lit(False)) if most <= 4 else F.exists("more", beside)
        return ~F.coalesce("has_section", F.lit(False)) | F.col("untimed") | some | F.coalesce(rest, F.lit(False))

    def fitting(self, rows: DataFrame, free_day: Column, no_early: Column) -> DataFrame:
        """Add n_feasible, n_timed and the first four feasible sections to rows (student, course): beside what is held, off the ``free_day``, and not in the first period with ``no_early``."""
        c = self.calendar
        rows = self.closed(rows, free_day, no_early).join(self.per_course.select("course", "n_timed", "_all"), "course", "left")
        rows = rows.withColumn("_fit", F.filter("_all", lambda s: ~c.meet(F.col("closed"), s["slots"])))
        four = F.transform(F.slice("_fit", 1, 4), lambda s: F.struct(*(s[n].alias(n) for n in ("ordinal", "section", "room", "meeting"))))
        counts = {"n_feasible": F.greatest(F.coalesce(F.size("_fit"), F.lit(0)), F.lit(0)), "n_timed": F.coalesce("n_timed", F.lit(0))}
        return rows.withColumns(counts | {"sections": four}).drop("_all", "closed", "_fit")
