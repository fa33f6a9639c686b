import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
PROSE = {
    "en": "the cat and the dog ran to the house of the king and it was on the way that they met with a fox ",
    "fr": "le chat et le chien dans la maison du roi est pour les enfants qui sont sur une route avec le renard ",
    "de": "die Katze und der Hund in dem Haus von einem König ist nicht auf der Straße mit den Kindern für das ",
}


@pytest.fixture(scope="session")
def texts():
    """Texts that operators must survive: null, empty, odd white space, very long, repeated, hardly any letters."""
    base = [None, "", " \n\t ", "one", "  lead  and\n\n trail \r\n", LONG, "naïve Été é \U0001f600 x y \x1c\x85",
            "a a a a a a a a a a a a", "12345 !!! ???", "<|endoftext|> it's we'll İΣ <|startoftext|>", "x" * 5000, "- " * 3000,
            PROSE["en"] * 4, PROSE["fr"] * 4, PROSE["de"] * 4, PROSE["en"] * 4, "one"]
    return base


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with the texts above, two rows that repeat an id, a null id, null sources and clashing extra columns."""
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "a", "b", "a"][i % 4], len(t or ""), "k", 7, 0.5)
            for i, t in enumerate(texts)]
    rows += [rows[12], (12, "another text of a repeated id", "en", "a", 1, None, None, None),
             (None, "a text without an id", None, "z", None, "k", 1, 1.0)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, score double")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
