"""Fixed values of the retrieval engine: word lists and patterns that results depend on, as plain text."""
# Fixed values. Order matters where the first match wins; frozensets are unordered.

ACADEMIC_QUERY_HINTS = ("research paper", "paper", "thesis", "dissertation", "acknowledg", "professor", "university", "department", "student", "faculty")
ACADEMIC_REPOSITORY_HINTS = ("repository", "scholarworks", "digitalcommons", "etd", "bitstream", "bitstreams", "vtechworks", "lib.", "viewcontent")
THESIS_CONTENT_HINTS = ("thesis", "dissertation", "master of", "doctor of philosophy", "doctoral", "submitted to", "in partial fulfillment")
ACKNOWLEDGEMENT_HINTS = ("acknowledg", "thank", "gratitude", "grateful", "appreciate")
CAREER_HINTS = ("professor", "assistant professor", "associate professor", "lecturer", "faculty", "appointed", "joined", "staff profile")
PAPER_QUERY_HINTS = ("doi", "journal", "article", "abstract", "authors", "author", "study", "sample size")
PAPER_CONTENT_HINTS = ("doi", "journal", "volume", "issue", "abstract", "keywords", "received", "accepted", "published", "article", "study")
MEDIA_QUERY_HINTS = (
    "manga", "anime", "comic", "comics", "graphic novel", "novel", "book", "story", "plot", "chapter", "episode", "season", "film", "movie",
    "television", "tv", "character", "characters", "antagonist", "protagonist", "villain", "hero", "companion", "group", "theme", "movement",
    "movements", "effect", "effects", "ability", "abilities", "technique", "techniques", "band", "song", "album", "game",
)
EVENT_QUERY_HINTS = (
    "festival", "festivity", "celebration", "pageant", "beauty pageant", "contest", "winner", "won", "queen", "coronation", "anniversary", "township",
    "municipality", "municipal", "province", "tourism", "cultural", "stew", "dish", "ingredient", "condiment",
)
EVENT_PAGE_HINTS = (
    "festival", "festivity", "celebration", "pageant", "beauty pageant", "contest", "winner", "won", "queen", "coronation", "candidate",
    "festival queen", "grand winner", "municipality", "municipal", "township", "province", "tourism", "cultural", "official",
)
EVENT_WINNER_HINTS = ("winner", "won", "beauty pageant", "pageant", "contest", "queen", "festival queen", "coronation", "candidate", "grand winner")
EVENT_WINNER_STRONG_HINTS = ("beauty pageant", "festival queen", "queen", "coronation", "crowned", "proclaimed", "declared", "grand winner")
EVENT_OFFICIAL_SOURCE_HINTS = (".gov", ".gov.ph", "tourism", "municipality", "municipal", "township", "province", "barangay", "cityhall", "city hall", "official")
LOW_TRUST_SOCIAL_SOURCE_HINTS = (
    "facebook.com/groups/", "facebook.com/share/", "facebook.com/reel/", "facebook.com/watch/", "facebook.com/video", "instagram.com", "quizlet.com",
    "snapchat.com", "tiktok.com", "pinterest.", "twitter.com", "x.com",
)
RECIPE_FOOD_PAGE_HINTS = (
    "allrecipes.com", "foodandwine.com", "foodnetwork.com", "seriouseats.com", "delish.com", "epicurious.com", "tasteofhome.com", "recipe", "recipes",
    "cooking", "cook", "ingredients", "simmer", "broth", "thanksgiving dinner",
)
BROAD_OVERVIEW_TITLE_HINTS = ("history of ", "category:", "list of ", "timeline of ", "outline of ", "index of ", "glossary of ", "portal:")
AGGREGATE_LISTING_HINTS = (
    "/stacks/", "interest stack", "interest stacks", "best of ", "top ", "top-", "ranking", "rankings", "recommendation", "recommendations",
    "watch order", "reading order",
)
GENERIC_OVERVIEW_TITLES = frozenset(["manga", "anime", "comic", "comics", "character", "characters", "fiction", "novel", "story"])
BROWSECOMP_LOW_SIGNAL_TERMS = frozenset([
    "after", "anime", "anniversary", "attended", "authorities", "based", "became", "begins", "certain", "character", "characters", "chapter",
    "celebration", "celebrations", "classic", "comic", "comics", "competition", "components", "contest", "created", "creator", "creators", "decade",
    "different", "draws", "early", "elements", "event", "festivities", "festivity", "first", "forms", "group", "highlight", "how", "interested",
    "known", "main", "manga", "many", "name", "novel", "one", "other", "particular", "people", "plot", "potential", "product", "province",
    "provincial", "published", "region", "released", "same", "school", "some", "story", "subject", "theme", "their", "them", "they", "town",
    "township", "uses", "used", "using", "what's", "winner", "written", "whose", "2000s",
])
MEDIA_WORK_SOURCE_HINTS = ("wikipedia.org", "fandom.com", "/wiki/", "wiki.", "myanimelist.net", "anime-planet.com", "tvtropes.org", "comicvine.gamespot.com", "mangadex.org")
MEDIA_WORK_STRONG_HINTS = (
    "manga", "anime", "chapter", "chapters", "episode", "episodes", "volume", "volumes", "series", "serialized", "serialization", "one-shot",
    "oneshot",
)
MEDIA_WORK_WEAK_HINTS = (
    "character", "characters", "fictional character", "plot", "premise", "adaptation", "debut", "arc", "mangaka", "protagonist", "antagonist",
    "companion",
)
MEDIA_NON_WORK_HINTS = (
    "muscle", "muscles", "exercise", "fitness", "workout", "writers become authors", "story structure", "writing advice",
    "how to choose the right antagonist",
)
FORUM_DISCUSSION_HINTS = ("reddit.com", "quora.com", "forum", "/threads/", "/thread/", "/comments/", "discussion")
BROWSECOMP_LINK_EXCLUDE_HINTS = (
    "/category:", "category:", "/history_of_", "history of ", "list of ", "/list_of_", "template:", "/template:", "portal:", "/portal:", "special:",
    "/special:", "help:", "/help:", "file:", "/file:", "user:", "/user:", "talk:", "/talk:", "action=", "?oldid=", "/tag/", "/tags/",
)
GENERIC_LINK_TEXT_HINTS = frozenset([
    "about", "browse", "categories", "chapter", "chapters", "character", "characters", "community", "contents", "episodes", "featured", "help",
    "history", "home", "index", "login", "main page", "next", "pages", "random", "recent changes", "register", "search", "series", "sign in",
    "special pages", "volume", "volumes", "wiki",
])
WIKI_META_SOURCE_HINTS = ("wikistats", "stats.wikimedia.org", "meta.wikimedia.org", "commons.wikimedia.org", "mediawiki.org", "wikimediafoundation.org")
GENERIC_MEDIA_TOPIC_TITLE_HINTS = (
    "anime and manga fandom", "anime fandom", "manga fandom", "anime and manga culture", "manga culture", "anime culture",
    "statistics for wikimedia projects", "wikistats",
)
GENERIC_EVENT_TOPIC_TITLE_HINTS = (
    "beauty pageant", "beauty contest", "beauty queen", "festival queen", "beauty pageant winners", "pageant winners",
    "american beauty pageant winners",
)
GENERIC_EVENT_TOPIC_TERMS = frozenset([
    "american", "beauty", "contest", "contests", "event", "events", "festival", "festivals", "miss", "mrs", "ms", "pageant", "pageants", "queen",
    "queens", "title", "titles", "winner", "winners",
])
BOSNIA_TOP_FOUR_CITY_TERMS = ("sarajevo", "banja luka", "tuzla", "zenica")
GENERIC_MEDIA_TOPIC_TERMS = frozenset([
    "anime", "manga", "fandom", "culture", "cultures", "demographics", "fan", "fans", "generation", "generations", "genre", "genres", "history",
    "industry", "industries", "media", "projects", "statistics", "topic", "topics", "wikimedia", "wikipedia", "wiki",
])
GENERIC_ENTITY_BLOCKLIST = frozenset(["anime", "manga", "fandom", "their", "them", "they", "wikimedia", "wikipedia", "wikistats"])
MEDIA_DISAMBIGUATION_HINTS = ("manga", "anime", "film", "movie", "novel", "comic", "comics", "character", "tv series", "television series", "video game", "game")
CHARACTER_QUERY_HINTS = ("character", "characters", "antagonist", "protagonist", "villain", "hero", "companion", "rival", "ally")
REFERENCE_HINTS = ("reference", "references", "bibliography", "cited", "citation", "works cited")
LOW_VALUE_TERMS = frozenset([
    "discussing", "discussion", "someone", "trying", "confirm", "details", "paper", "research", "discussed", "particular", "focused", "study",
    "section", "person", "student", "expressed", "later", "became", "last", "name", "confirming", "sometime",
])
PERSON_QUERY_HINTS = ("who", "whom", "last name", "surname", "full name", "first and last name", "first and last names", "person")
ORGANIZATION_NAME_HINTS = frozenset([
    "academy", "agency", "association", "authority", "best", "bureau", "center", "centre", "city", "college", "commission", "committee", "corporation",
    "council", "department", "development", "division", "event", "festival", "final", "government", "group", "history", "information", "institute",
    "jamaica", "letter", "letters", "ministry", "municipal", "municipality", "office", "organisation", "organization", "pageant", "picture",
    "province", "provincial", "queen", "region", "school", "service", "society", "title", "tourism", "university",
])
NON_PERSON_TITLE_HINTS = frozenset([
    "academy", "america", "american", "award", "awards", "best", "blog", "california", "category", "counselor", "counsellor", "county", "episode",
    "event", "fame", "final", "health", "history", "international", "letter", "letters", "mental", "miss", "mrs", "ms", "oscar", "outstanding", "page",
    "pageant", "picture", "post", "posts", "question", "questions", "quiz", "round", "same", "season", "show", "story", "teen", "title", "titles",
    "today", "trivia", "tournament", "universe", "usa", "video", "winner", "winners",
])
NON_PERSON_CATEGORY_HINTS = frozenset([
    "agriculture", "arts", "baking", "beauty", "best", "booth", "career", "choreography", "consumer", "costume", "dance", "dancing", "design",
    "education", "excellence", "festival", "finishing", "history", "leadership", "mathematics", "musicality", "newsletter", "official", "pageant",
    "painting", "performance", "poster", "presentation", "programme", "program", "province", "provincial", "public", "queen", "science", "service",
    "skills", "small", "soft", "speaking", "speech", "storyline", "studies", "study", "talent", "tourism", "training", "update", "weekly", "winner",
    "winners",
])
MULTI_HOP_RELATIONSHIP_HINTS = (
    "later", "before", "after", "between", "fewer than", "less than", "more than", "under", "over", "founded", "appointed", "became", "joined",
    "acknowledg", "professor", "department", "university",
)
STOPWORDS = frozenset([
    "a", "an", "and", "are", "as", "at", "be", "between", "by", "did", "do", "does", "for", "from", "had", "has", "have", "in", "into", "is", "it",
    "its", "me", "my", "of", "on", "or", "that", "the", "their", "there", "these", "this", "those", "to", "was", "were", "what", "when", "where",
    "which", "who", "with",
])
QUESTION_PREFIXES = (
    "what is ", "what are ", "who is ", "who are ", "which ", "where is ", "where are ", "when is ", "when are ", "tell me about ", "find ",
    "search for ",
)
CONSTRAINT_PATTERNS = (
    r"\b(?:between|from)\s+\d{4}\s+(?:and|to|-)\s+\d{4}\b",
    r"\b(?:before|after|since|during|in)\s+\d{4}\b",
    r"\b(?:before|after|since|during|in)\s+(?:the\s+)?\d{4}s\b",
    r"\b(?:fewer than|less than|more than|greater than|under|over|at least|at most|minimum of|maximum of)\s+\d+(?:\s+[a-zA-Z-]+){0,4}\b",
    '[\'\\"][^\'\\"]{2,80}[\'\\"]',
)
AUTHOR_LINE_PATTERNS = (
    r"\b(?:by|author|written by|submitted by|prepared by)\s*[:,-]?\s*([A-Z][A-Za-z'`.-]+(?:\s+[A-Z][A-Za-z'`.-]+){1,3})\b",
    r"(?i)\b([A-Z][A-Za-z'`.-]+(?:\s+[A-Z][A-Za-z'`.-]+){1,3}),?\s+(?:master(?:'s)?|phd|doctoral|doctor of philosophy|dissertation|thesis)\b",
)
INSTITUTION_ENTITY_PATTERNS = (
    r"\b([A-Z][A-Za-z&'`.-]+(?:\s+[A-Z][A-Za-z&'`.-]+){0,6}\s+(?:University|College|Institute|School))\b",
    r"\b(Department of [A-Z][A-Za-z&'`.-]+(?:\s+[A-Z][A-Za-z&'`.-]+){0,6})\b",
    r"\b(School of [A-Z][A-Za-z&'`.-]+(?:\s+[A-Z][A-Za-z&'`.-]+){0,6})\b",
    r"\b(College of [A-Z][A-Za-z&'`.-]+(?:\s+[A-Z][A-Za-z&'`.-]+){0,6})\b",
)
PERSON_NAME_PATTERN = r"\b(?:Dr\.?\s+|Prof\.?\s+|Professor\s+)?([A-Z][A-Za-z'`.-]+(?:\s+[A-Z][A-Za-z'`.-]+){1,3})\b"
TITLECASE_ENTITY_PATTERN = r"\b([A-Z][A-Za-z0-9'`.-]+(?:\s+[A-Z][A-Za-z0-9'`.-]+){0,4})\b"
TITLECASE_ENTITY_BLOCKLIST = frozenset([
    "Abstract", "Acknowledgements", "Acknowledgments", "Acknowledgement", "Bibliography", "Chapter", "Contents", "December", "Figure", "Her", "His",
    "Introduction", "Its", "January", "Many", "March", "One", "References", "Section", "Table", "The", "This", "Those", "Their", "What", "When",
    "Where", "Which", "Who",
])
ACKNOWLEDGEMENT_SECTION_TITLES = ("acknowledgements", "acknowledgments", "acknowledgement")
REFERENCE_SECTION_TITLES = ("references", "bibliography", "works cited")
DOI_PATTERN = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
REFERENCE_STYLE_YEAR_PATTERN = r"\(\d{4}\)|\b\d{4};\d"
REFERENCE_STYLE_AUTHOR_PATTERN = r"\b[A-Z][A-Za-z'`.-]+,\s*(?:[A-Z]\.\s*){1,4}"
FRONT_MATTER_CHAR_LIMIT = 3000

NUMBER_WORDS = {'one': 1, 'two': 2, 'three': 3, 'four': 4, 'five': 5, 'six': 6, 'seven': 7, 'eight': 8, 'nine': 9, 'ten': 10}

SAMPLE_ENTITY_HINTS = ("couple", "couples", "participant", "participants", "subject", "subjects", "adult", "adults", "people", "respondent", "respondents")
MONTH_YEAR_PATTERN = r"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+((?:19|20)\d{2})\b"
AUTHOR_COUNT_PATTERN = r"(?i)\b(?P<count>\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+authors?\b"
SAMPLE_RANGE_PATTERN = r"(?i)\b(?:sample(?: size)?|participants?|subjects?|couples?|respondents?|adults?|people)\b[^.]{0,80}?\b(?:between|ranging from)\s+(\d{2,5})\s+(?:and|to|-)\s+(\d{2,5})\b"
REFERENCE_RANGE_PATTERN = r"(?i)\breferences?(?: cited)?[^.]{0,120}?\bbetween\s+(\d{4})\s+(?:and|to|-)\s+(\d{4})\b"
INSTITUTION_RANGE_PATTERN = r"(?i)\b(?:university|institution|college|school)[^.]{0,80}?\bfounded\b[^.]{0,60}?\bbetween\s+(\d{4})\s+(?:and|to|-)\s+(\d{4})\b"
PUBLICATION_YEAR_PATTERN = r"(?i)\b(?:as of|published|dated|from|in)\s+(?:january|february|march|april|may|june|july|august|september|october|november|december\s+)?((?:19|20)\d{2})\b"
SAMPLE_SIZE_PATTERNS = (
    r"(?i)\bN\s*=\s*(\d{2,5})\b",
    r"(?i)\b(?:sample of|included|examined|surveyed|studied|followed)\s+(\d{2,5})\s+(?:married\s+|cohabiting\s+|older\s+|young\s+)?(?:couples?|participants?|subjects?|adults?|people|respondents?)\b",
    r"(?i)\b(\d{2,5})\s+(?:married\s+|cohabiting\s+|older\s+|young\s+)?(?:couples?|participants?|subjects?|adults?|people|respondents?)\b",
)
FOUNDED_YEAR_PATTERN = r"(?i)\b(?:founded|established|chartered)\s+(?:in\s+)?((?:19|20)\d{2})\b"


SECTION_END_TITLES = frozenset(["abstract", "introduction", "table of contents", "contents", "references", "bibliography", "appendix", "chapter 1", "chapter one", "dedication"])
THANK_PATTERNS = (
    r"\b(?:thank|thanks|grateful to|gratitude to|appreciate|indebted to)\s+(?:Dr\.?\s+|Prof\.?\s+|Professor\s+)?([A-Z][A-Za-z'`.-]+(?:\s+[A-Z][A-Za-z'`.-]+){1,3})",
    r"\b(?:to|for)\s+(?:Dr\.?\s+|Prof\.?\s+|Professor\s+)?([A-Z][A-Za-z'`.-]+(?:\s+[A-Z][A-Za-z'`.-]+){1,3})\b(?:,|\s+who|\s+for|\s+whose)",
)
DEFAULT_SNIPPET_LENGTH = 320

DEDUPLICATION_SIMILARITY_THRESHOLD = 0.92

KEYWORD_WINDOW_RADIUS = 180


MAX_KEYWORD_WINDOW_CANDIDATES = 10


MAX_RETRIEVAL_CLUES = 10


MAX_SIMPLE_RETRIEVAL_CLUES = 2



ENCYCLOPEDIC_SOURCE_HINTS = ("wikipedia.org", "fandom.com", "wiki", "wikitia", "comicvine.gamespot.com", "anime-planet.com", "myanimelist.net", "tvtropes.org")
ABILITY_QUERY_HINTS = (
    "ability", "abilities", "power", "powers", "move", "moves", "movement", "movements", "effect", "effects", "technique", "techniques", "attack", "attacks",
)
NON_RESEARCH_PAGE_HINTS = ("course", "program", "precollege", "summer college", "major", "minor", "degree requirements", "admissions", "apply now")
PERSON_CONTEXT_HINTS = ("author", "student", "professor", "faculty", "advisor", "supervisor", "mentor")

# Memorial years: sources, contexts and words of pages that answer when something happened.
MEMORIAL_SOURCE_HINTS = ("spomenikdatabase.org",)
YUGOSLAV_HINTS = ("former yugoslavia", "yugoslavia", "yugoslav", "socialist yugoslavia")
PERSON_BIOGRAPHY_HINTS = ("artist", "artists", "author", "authors", "awards", "biography", "born", "career", "died", "legacy", "profile", "sculptor", "sculptors")
MEMORIAL_PAGE_HINTS = ("monument", "memorial", "spomenik", "spomenpark")
CASUALTY_HINTS = ("victims", "massacre", "battle", "killed", "died", "executed", "detachment", "loss of lives", "commemorates", "fallen fighters")
MEMORIAL_TITLE_HINTS = ("memorial on", "monument to", "spomenik", "spomenpark", "victims of", "massacre")
MEMORIAL_EVIDENCE_HINTS = ("victims", "massacre", "battle", "killed", "died", "executed", "commemorates", "in honor", "dedication", "memorial", "monument", "spomenik")
MEMORIAL_ARTIST_HINTS = ("artist", "sculptor", "designed by", "author", "miodrag", "živković", "zivkovic")

# Answers: words near a year that tell what happened in it, and words that no person's name has.
YEAR_EVENT_HINTS = (
    "event", "occur", "loss of lives", "lost their lives", "victims", "victim", "massacre", "battle", "attack", "tragedy", "killed", "died",
    "death", "executed", "honor", "in their honor", "commemorates", "commemorating", "dedicated", "dedication", "memorial", "monument", "spomenik",
)
YEAR_BIOGRAPHICAL_HINTS = ("born", "birth", "artist", "sculptor", "author", "architect")
YEAR_CONSTRUCTION_HINTS = ("built", "constructed", "erected", "unveiled", "opened", "completed", "installed")
YEAR_CENSUS_HINTS = ("census", "population")
YEAR_AWARD_HINTS = ("award", "awards", "competition", "prize", "salon", "triennale", "biennale", "medal")
NO_NAME_TERMS = ("festival", "celebration", "township", "province", "instagram", "facebook", "wikipedia", "stew", "dish", "contest", "winner")
