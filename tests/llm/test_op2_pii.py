import re

from pyspark.sql import functions as F

from pagewright.llm import op2_pii as m
from tests.llm import edge


def redact(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in m.replace_entities(df, key).orderBy("doc_id").collect()]


def luhn(number):
    d = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def test_formats(spark):
    texts = ["mail me.12@mail4.example.com now", "AT 10.20.30.40!", "+1 (017) 555-7713", "card 4111 1111 1111 1111.", "078-05-1120", 'token = "5fa2b6cdb08be96a4a469e25fa2b6cdb08be96a4"', "DE89 3704 0044 0532 0130 00", "Mr John Smith", "Frau Müller", "Господин Иван Петров", "A.B@C.COM"]
    out = redact(spark, texts)
    forms = [r"mail [a-p]{12}\.\d\d@[a-p]{6}\.example\.com now", r"AT (\d{1,3}\.){3}\d{1,3}!", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"card \d{4} \d{4} \d{4} \d{4}\.", r"\d{3}-\d{2}-\d{4}", r'token = "[0-9a-f]{40}"', r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", r"Mr (Adam|Bruno|Carl|David|Emil|Felix|Hugo|Leo) [A-Z][a-z]{7}", r"Frau [A-Z][a-z]{7}", r"Господин (Антон|Борис|Виктор|Глеб|Денис|Иван|Павел|Роман) [А-Я][а-я]{7}", r"[A-P]{12}@[A-P]{6}\.EXAMPLE\.COM"]
    for before, after, form in zip(texts, out, forms, strict=True):
        assert before != after and re.fullmatch(form, after), (before, after)
    assert luhn(out[3]) == luhn(texts[3]) == 0
    assert all(0 <= int(x) <= 255 for x in re.findall(r"\d+", out[1]))


def test_coreference_and_keys(spark):
    a, b = redact(spark, ["call +1 (017) 555-7713 or 1.2.3.4", "1.2.3.4 and 1.2.3.5"])
    assert a.rsplit(" ", 1)[1] == b.split(" ")[0] != b.split(" ")[2]
    assert redact(spark, ["1.2.3.4"], "k") != redact(spark, ["1.2.3.4"], "other")


def test_capitals(spark):
    low, high = redact(spark, ["5fa2b6cdb08be96a4a469e25fa2b6cdb08be96a4", 'TOKEN = "5FA2B6CDB08BE96A4A469E25FA2B6CDB08BE96A4"!!'])
    assert high == f'TOKEN = "{low.upper()}"!!'
    low, high = redact(spark, ["of.12@mail4.example.com", "OF.12@MAIL4.EXAMPLE.COM!!"])
    assert high == f"{low.upper()}!!"


def test_distinct_values_stay_distinct(spark):
    phones = [f"+1 (017) 555-{n:04d}" for n in range(400)] + [f"10.0.{n}.1" for n in range(200)] + [f"{4000000000000000 + n}" for n in range(200)]
    out = redact(spark, phones)
    assert len(set(out)) == len(phones)


def test_collisions_are_resolved(spark, monkeypatch):
    monkeypatch.setattr(m, "surrogate_key", lambda v, bump, key: F.concat(F.lit("s"), (F.length(v) % 2 + bump).cast("string")))
    values = spark.createDataFrame([(v,) for v in ("aaaa", "bb", "c", "s1")], "value string")
    bumps = {r["value"]: r["bump"] for r in m.find_collisions(values, "k").collect()}
    made = {v: f"s{len(v) % 2 + bumps.get(v, 0)}" for v in ("aaaa", "bb", "c", "s1")}
    assert len(set(made.values())) == 4 and "s1" not in made.values()


def test_more_names_than_short_surrogates(spark, monkeypatch):
    monkeypatch.setattr(m, "SYLLABLES", {"latin": ["ba", "de"], "cyrillic": ["ба", "де"]})  # 16 family names of four syllables
    rounds = []

    def kept(df, name, keep=m.keep):
        rounds.append(name)
        assert len(rounds) < 60, "no end"
        return keep(df, name)

    monkeypatch.setattr(m, "keep", kept)
    names = [f"Mr {a}{b}" for a in ("Smith", "Jones", "Kent") for b in "abcdefghijklmnop"]
    out = redact(spark, names)
    assert len(set(out)) == len(names) and not set(out) & set(names)


def test_one_entity_has_one_surrogate(spark):
    a, b, mixed = redact(spark, ["Bob.Lee@mail.example.com", "bob.lee@mail.example.com", "bob.LEE@mail.example.com"])
    assert a.lower() == b.lower() == mixed.lower()
    a, b = redact(spark, ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"])
    assert a.replace(" ", "") == b and a != b
    a, b = redact(spark, ["4111 1111 1111 1111", "4111-1111-1111-1111"])
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    full, short, lady, other, john = redact(spark, ["Mr John Smith", "Mr Smith", "Mrs Smith", "Mr Jack Smith", "Herr John Miller"])
    family = full.split()[-1]
    assert short == f"Mr {family}" and lady == f"Mrs {family}" and other.split()[-1] == family
    assert full.split()[1] == john.split()[1] != other.split()[1] and john.split()[-1] != family


def test_iban_check_digits(spark):
    def rest(v):
        v = v.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97

    valid, wrong = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606"], ["DE88 3704 0044 0532 0130 00"]
    out = redact(spark, valid + wrong)
    assert all(rest(v) == 1 for v in valid) and [rest(v) == 1 for v in out] == [True, True, True, False]
    for before, after in zip(valid + wrong, out, strict=True):
        assert before[:2] == after[:2] and re.sub("[0-9]", "9", re.sub("[A-Z]", "A", before)) == re.sub("[0-9]", "9", re.sub("[A-Z]", "A", after))


def test_all_entities_against_brute_force(spark):
    """Coreference and distinctness over all entities of a corpus, by comparing each entity with its replacement."""
    docs = edge.table(spark, "documents", "sf0.01").select("doc_id", "text")
    pairs = docs.withColumn("found", m.entities(F.col("text"))).join(m.replace_entities(docs, "k").select("doc_id", F.col("text").alias("after")), "doc_id").filter("size(found) > 0").toPandas()
    whole, made = re.compile("|".join(r"[\w.%+-]+@[\w.-]+|\d{16}|\+\d \(\d{3}\) \d{3}-\d{4}|[0-9a-f]{40}|\d+\.\d+\.\d+\.\d+".split("|"))), {}
    for before, after in zip(pairs["text"], pairs["after"], strict=True):
        a, b = whole.findall(before), whole.findall(after)
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert made.setdefault(x.lower(), y.lower()) == y.lower() and x != y
    assert len(made) > 50 and len(set(made.values())) == len(made) and not set(made) & set(made.values())


def test_planted_names_are_gone(spark):
    """Names of many forms in real texts: no word of them is left, and each has the same replacement everywhere."""
    names = ["Mr John Ronald Smith", "Dr Smith", "John Smith", "Prof. Anne-Marie O'Brien", "Mrs. J. R. Smith", "Herr Karl Heinz von-Berg", "Мария Петрова", "Señora Isabel García Márquez", "Doctor John Smith", "Dame Elizabeth"]
    base = [r["text"] for r in edge.table(spark, "documents").select("text").limit(40).collect()]
    texts = [f"{t[:200]}\nwith {names[i % len(names)]}, who said so.\n{t[200:]}" for i, t in enumerate(base)]
    out = redact(spark, texts)
    real = {w for n in names for w in re.findall(r"[\w'-]{3,}", n)} - {"Prof", "Mrs", "Herr", "Señora", "Doctor", "Dame"}
    seen = {}
    for i, (before, after) in enumerate(zip(texts, out, strict=True)):
        found = re.search(r"with (.*), who said so\.", after)[1]
        assert not real & set(re.findall(r"[\w'-]+", found)) and len(found.split()) == len(names[i % len(names)].split())
        assert seen.setdefault(names[i % len(names)], found) == found
        assert before.split("\nwith")[0].count(" ") == after.split("\nwith")[0].count(" ")
    assert len(set(seen.values())) == len(names)
    family = seen["Dr Smith"].split()[1]
    assert [seen[n].split()[-1] for n in ("Mr John Ronald Smith", "John Smith", "Mrs. J. R. Smith", "Doctor John Smith")] == [family] * 4
    assert seen["John Smith"].split()[0] == seen["Doctor John Smith"].split()[1] == seen["Mr John Ronald Smith"].split()[1]
    assert re.fullmatch(r"Mrs\. [A-Z]\. [A-Z]\. \w+", seen["Mrs. J. R. Smith"]) and re.fullmatch(r"[А-Я][а-я]+ [А-Я][а-я]+", seen["Мария Петрова"])


def test_phones_in_any_layout_are_one(spark):
    out = redact(spark, ["+1 555 123 4567", "+15551234567", "+1 (555) 123-4567", "+1.555.123.4567", "+49 30 901820", "+4930901820", "(555) 123-4567", "555-123-4567", "555-123-4568"])
    digits = [re.sub(r"[^0-9+]", "", x) for x in out]
    assert len({*digits[:4]}) == 1 and digits[0][:2] == "+1" and digits[0] != "+15551234567"
    assert digits[4] == digits[5] and digits[4].startswith("+49") and digits[6] == digits[7] != digits[8]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[2])


def test_plan_has_no_python(spark):
    out = m.replace_entities(edge.table(spark, "documents").select("doc_id", "text"))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_clean_text_stays(spark):
    texts = ["no data here", "in 2024, 12 of 345.", "version 1.2.3", "a@b", "Misty Mr. x"]
    assert redact(spark, texts) == texts


def test_planted_values_are_gone(spark):
    d = edge.by_id(edge.table(spark, "documents"))
    out = m.op2_pii_surrogates(spark, "/root/testdata/sf0.001").orderBy("doc_id").toPandas()
    for before, after in zip(d["text"], out["text"], strict=True):
        for pattern in (r"\S+@\S+\.com", r"\d{16}", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"[0-9a-f]{40}", r"\d+\.\d+\.\d+\.\d+"):
            for value in re.findall(pattern, before):
                assert value not in after
    same = out["n_entities"] == 0
    assert (d["text"][same] == out["text"][same]).all()


def test_edges(spark):
    out = m.replace_entities(edge.docs(spark))
    assert out.columns == [*edge.docs(spark).columns, "n_entities"]
    assert m.replace_entities(edge.docs(spark).withColumnRenamed("copies", "n_entities")).columns.count("n_entities") == 1
    assert out.count() == len(edge.ROWS)
    assert out.filter("text is null").count() == 2
    assert m.replace_entities(edge.empty(spark)).count() == 0
