"""Lists, tables and constants that results depend on."""

from __future__ import annotations

# Words that never count as keywords.
STOP_WORDS = [
    "a", "an", "and", "are", "course", "courses", "find", "for", "i", "in",
    "is", "me", "need", "of", "on", "prefer", "related", "suggest", "the", "to", "want", "with",
    "del", "dels", "huel", "huels", "opel", "opels", "cdc", "cdcs", "please",
    "no", "without", "quiz", "quizzes", "sugesst", "sugest", "attendance", "requirement",
    "midsem", "mid-sem", "compre", "evaluation", "project", "projects", "project-based",
    "open-book", "makeup", "make-up", "lenient", "small", "low", "lower", "light", "weight",
]

# Abbreviations that stand for two keywords.
EXPANSIONS = {"ai": ["artificial", "intelligence"], "ml": ["machine", "learning"]}

# Names of days in meeting texts.
DAYS = {"m": "Mon", "t": "Tue", "tu": "Tue", "w": "Wed", "th": "Thu", "f": "Fri", "s": "Sat", "sa": "Sat", "su": "Sun"}

# Electives of the discipline that a programme requires, where it is not 4.
ELECTIVES_REQUIRED = {
    "BIOTECHNOLOGY": 5,
    "BIOTECHNOLOGY WITH SPECIALIZATION IN APPLIED MOLECULAR BIOLOGY": 5,
    "CHEMICAL ENGINEERING": 5,
    "CHEMICAL ENGINEERING WITH SPECIALIZATION IN ENERGY, ENVIRONMENT, AND SUSTAINABILITY": 5,
    "CHEMISTRY": 4,
    "ECONOMICS": 6,
    "MATHEMATICS": 5,
    "BIOLOGICAL SCIENCES": 4,
    "PHYSICS": 4,
    "PHYSICS WITH SPECIALIZATION IN SPACE SCIENCE AND TECHNOLOGY": 4,
    "SEMICONDUCTOR AND NANOSCIENCE": 7,
}
ELECTIVES_DEFAULT = 4
HUMANITIES_REQUIRED = 3
OPEN_REQUIRED = 5

# Unit limits per semester, the restricted admission year, result limits.
UNIT_LIMIT = {"first_degree": 25}
UNIT_LIMIT_OTHER = 20
RESTRICTED_YEAR = 2026
RESTRICTED_FROM = 5000
MOST_RESULTS = 25
DEFAULT_RESULTS = 8

# Rules that are materialised from a regulation clause, if the clause exists.
TYPED_RULES = [
    ("1.01", "semester_unit_limit", '{"first_degree": 25, "higher_degree": 20}'),
    ("1.03", "summer_limit", '{"maximum_courses": 3, "maximum_units": 10}'),
    ("2.08", "additional_elective_limit", '{"first_degree": 4}'),
    ("2.10", "practice_school_exclusive", '{"exclusive_registration": true}'),
    ("2.10", "thesis_16_exclusive", '{"thesis_units": 16, "exclusive_registration": true}'),
    ("2.10", "thesis_9_concurrent_limit", '{"thesis_units": 9, "maximum_other_courses": 3, "maximum_other_units": 9}'),
]

# Header of the timetable.
TERM, CAMPUS = "FIRST SEMESTER 2026-27", "Pilani"
SESSION_TIMES = {
    "FN1": "09:00-10:30", "FN2": "11:00-12:30", "AN1": "14:00-15:30", "AN2": "16:00-17:30",
    "FN": "09:00-12:00", "AN": "14:00-17:00",
}

# Kinds of assessment in order of precedence, with the pattern that shows each.
COMPONENT_KINDS = [
    ("midsem", r"\bmid[-.\s]*(?:semester|sem|term)\b"),
    ("compre", r"\bcompre"),
    ("case_study", r"\bcase stud"),
    ("project", r"\bproject"),
    ("viva", r"\bviva"),
    ("quiz", r"\bquiz"),
    ("assignment", r"\bassignment"),
    ("presentation", r"\b(?:presentation|seminar)"),
    ("lab", r"\blab"),
    ("participation", r"\bclass participation"),
    ("test", r"\btest"),
]

# Topics that are looked for in descriptions.
TOPICS = [
    "artificial intelligence", "machine learning", "deep learning", "neural networks",
    "natural language processing", "computer vision", "reinforcement learning",
    "data science", "data mining", "algorithms", "data structures", "databases",
    "operating systems", "computer networks", "cybersecurity", "robotics",
    "optimization", "probability", "statistics", "linear algebra", "calculus",
    "aerodynamics", "flight mechanics", "aircraft systems", "propulsion",
    "thermodynamics", "fluid mechanics", "heat transfer", "quantum mechanics",
    "electromagnetism", "signal processing", "control systems", "electronics",
    "genetics", "microbiology", "cell biology", "molecular biology", "biochemistry",
    "biological chemistry", "plant physiology", "animal physiology", "evolution",
    "DNA", "enzymes", "proteins", "carbohydrates", "lipids", "nucleic acids",
    "bioenergetics", "metabolism", "photosynthesis", "biomolecular modeling",
    "molecular modeling", "gene cloning", "recombinant DNA", "biotechnology",
    "economics", "finance", "accounting", "marketing", "psychology", "philosophy",
    "sociology", "literature", "entrepreneurship", "sustainability",
]

# Preference flags with the pattern (on the lower-cased query) that sets each.
QUERY_FLAGS = {
    "no_attendance": r"no attendance|attendance (?:not required|optional)",
    "no_quiz": r"\bno\s+quizz?(?:es)?\b|\bwithout\s+(?:any\s+)?quizz?(?:es)?\b",
    "no_midsem": r"no mid[- ]?sem|without (?:a )?mid",
    "low_midsem": r"(?:small|low|lower|light)\s+(?:weight(?:age)?\s+)?mid[- ]?sem|mid[- ]?sem.*(?:small|low|lower|light)",
    "fewer_quizzes": r"(?:few|fewer|less|minimum)\s+quizz?(?:es)?",
    "high_project_weight": r"(?:high|higher|more|maximum)\s+project(?:\s+weight(?:age)?)?|project[- ]based",
    "low_exam_weight": r"(?:low|lower|less|minimum)\s+(?:exam|examination)\s+weight",
    "no_compre": r"no compre|without (?:a )?compre",
    "project_based": r"project[- ]based|(?:prefer|with) projects?",
    "open_book": r"open[- ]?book",
    "no_early_classes": r"no 8\s*(?:am|a\.m\.)|avoid 8\s*(?:am|a\.m\.)|no early",
    "makeup_requested": r"make[- ]?up",
}
LENIENT = r"lenient|easy\s+make[- ]?up"
CATEGORIES = ["cdc", "del", "huel", "opel"]
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
WEEKDAY_STEMS = ["mondays?", "tuesdays?", "wednesdays?", "thursdays?", "fridays?", "saturdays?"]
FREE_DAY = r"free|avoid|no class"

# Numbers written as words.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
