"""Relations that queries run over: driver tables seen as pages, questions and evaluation records, and invented rows."""

from __future__ import annotations

from tidemark.functions.dialect import Dialect

#: Invented pages that touch the predicates' cases (url, title, text).
PAGES = (
    ("https://www.Example.org/a/b/?q=1#top", "The Lamp Maker", "Ana Perez Lund built lamps. She won the contest in 1984."),
    ("https://en.wikipedia.org/wiki/History_of_lamps", "History of lamps - Wikipedia", "The history of lamps begins early."),
    ("https://fr.m.wikipedia.org/wiki/Lampe", "Lampe", "Une lampe."),
    ("https://meta.wikimedia.org/wiki/Portal:Lamps", "Portal:Lamps", "special: page"),
    ("https://www.reddit.com/r/lamps", "Lamps forum thread : r/lamps", "posted by u/x"),
    ("https://news.town.gov/festival", "Harvest Festival Queen crowned", "The official festival pageant: Maria Clara Santos was crowned winner of the beauty pageant at the coronation night. The municipality and tourism office celebrate the anniversary."),
    ("https://food.example.com/recipe", "Stew recipe", "Ingredients and preparation: cook the recipe. Serves four. Nutrition and cooking time."),
    ("https://shop.example.edu/thesis.pdf", "[PDF] Thesis on Lamps | Scholarworks", "Submitted to the Department of Physics, Orchid University, in partial fulfillment. doi 10.1234/ab.cd-9). Acknowledgements: I thank Dr. Jane Q. Doe for help. Abstract. Keywords."),
    ("https://fandom.example.com/list", "List of characters - Fandom", "manga series serialized in a magazine. Chapter list. Main character profile."),
    ("https://example.net/anime", "Anime culture", "anime statistics and generation"),
    ("https://spomenik.example.com/m", "Monument to Victims in Mostar", "The memorial built in 1961 commemorates victims killed in the battle. The sculptor, born in 1930, worked in Bosnia and Yugoslavia."),
    ("https://www.facebook.com/groups/1", "Pageant fans", "like and share"),
    ("", "", ""),
    ("ftp://files.example.org", "Wiki", "x"),
    ("//cdn.example.org/x/", "Category: Beauty Pageant Winners", "american beauty pageant winners"),
    ("not a url", "  Spaced \t Title\n", "line one\r\n\r\n  line   two "),
    ("https://example.org/bio", "Ivan Petrov", "Ivan Petrov (born 1950) is a painter. Early life. Biography. Personal life."),
    ("https://example.org/refs", "References", "Lund, A. B. (1999). Lamps. Journal of Light, 12(3), pp. 4-9. Oak, C. (2001); see also 1984;2."),
)
#: Invented questions.
QUESTIONS = (
    "What is the DOI of the research paper by three authors with a sample size of couples between 40 and 90, published in March 2014?",
    "Who won the beauty pageant at the festival named after a local stew, before 2010 and after 1990?",
    "Which manga series features a character whose ability is based on a clock?",
    "what year was the monument to the victims in Bosnia constructed prior to 1970 by a sculptor who was born in 1930?",
    "What is the last name of the professor thanked in the thesis acknowledgements?",
    "Tell me about lamps",
    "How many students attended the university founded between 1850 and 1900?",
    "Which article about growth, violence and schools was written by the person who admitted the children in 1999; and in which articles?",
    "who is the lecturer that later joined the faculty in the UK",
    "references cited between 1990 and 1999 in the journal article 'Light at Night'",
    "What is the title of the pdf, at least 20 pages long, that cites \"old lamps\"?",
    "What's the number of chapters of the novel released between 1990 and 1995?",
    "",
    "Find which institution studied 120 participants",
    "and or but",
)


def pages(d: Dialect) -> str:
    """Invented and crawled pages: id, url, title, text (tags taken out)."""
    own = d.rows("v", ("id", "url", "title", "text"), [(-k - 1, *row) for k, row in enumerate(PAGES)])
    title = d.replace_all(d.extract("html", r"(?is)<title[^>]*>([^<]*)", 1), "&amp;", "&")
    text = d.replace_all(d.replace_all("html", r"(?is)<(script|style)[^>]*>[^<]*"), r"<[^>]*>", " ")
    return f"(SELECT id, url, title, text FROM {own} u UNION ALL SELECT page_id AS id, url, {title} AS title, {text} AS text FROM {d.table('pages')})"


def questions(d: Dialect) -> str:
    """Invented questions, benchmark items and what users say: id, query."""
    own = d.rows("v", ("id", "query"), [(-k - 1, q) for k, q in enumerate(QUESTIONS)])
    said = f"SELECT 1000000 + conv_id * 1000 + turn AS id, coalesce(text, '') AS query FROM {d.table('conversations')} WHERE role = 'user'"
    return f"(SELECT id, query FROM {own} u UNION ALL SELECT item_id AS id, text AS query FROM {d.table('benchmark')} UNION ALL {said})"


def evaluation(d: Dialect) -> str:
    """Evaluation records made from labels: model, configuration, query type, tool, accuracy, coherence, latency, documents."""
    pick = lambda key, names: f"CASE {key} " + " ".join(f"WHEN {k} THEN {d.lit(n)}" for k, n in enumerate(names)) + " END"
    return f"""(SELECT doc_id AS query_id, {pick('doc_id % 4', ('GPT-4o', 'DeepSeek-R1', 'Llama 3.1 70B', 'Claude 3.5 Sonnet'))} AS model_name, {pick('doc_id % 3', ('c1', ' C2 ', 'TAG'))} AS configuration,
      {pick('doc_id % 2', ('static', 'DYNAMIC'))} AS query_type, {pick('(doc_id + quality) % 4', ('Detailed', 'Basic', 'None', ''))} AS tool_invoked, CASE WHEN toxic = 1 THEN 'Yes ' ELSE 'no' END AS query_refined,
      CAST(quality AS DOUBLE) AS factual_accuracy, CAST(1 + doc_id % 5 AS DOUBLE) AS coherence_score, CAST(doc_id % 50 AS DOUBLE) / 2 AS latency_total, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 7 END AS DOUBLE) AS num_documents FROM {d.table('labels')})"""


def hits(d: Dialect) -> str:
    """Search hits made from pages: every page answers the clue of its number, with repeats by another spelling of the URL."""
    base = f"SELECT page_id, url, html FROM {d.table('pages')}"
    return f"""(SELECT page_id % 20 AS query_id, page_id AS pos, url, {d.extract('html', r'(?is)<title[^>]*>([^<]*)', 1)} AS title, CAST(page_id % 7 AS DOUBLE) / 7 AS retrieval_score, concat('clue ', CAST(page_id % 3 AS {d.string})) AS clue, html AS content FROM ({base}) b
      UNION ALL SELECT page_id % 20, page_id + 1000000, concat(replace(url, 'https://', 'http://www.'), '/?again=1'), '', CAST(page_id % 5 AS DOUBLE) / 5, 'clue 9', CASE WHEN page_id % 8 = 0 THEN concat(html, ' again') ELSE 'short' END FROM ({base}) c WHERE page_id % 4 = 0)"""
