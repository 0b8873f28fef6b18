from pyspark.sql import functions as F

from parley.functions.persona import persona_instruction, persona_switch
from parley.functions.render import persona_prompt


def run(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", build(F.col("t"))).orderBy("i").collect()]


def test_instruction(spark):
    cases = {
        "Be Iron Man today and talk to me.": ("Iron Man today", "talk to me"),
        "Act like a wise mentor.": ("wise mentor", "Begin."),
        "be honest": None,
        "be honest, then act like a Pirate!": ("Pirate", "Begin."),
        "pretend to be a pirate for now": ("pirate", "Begin."),
        "pretend to be a pirate for now and sing": ("pirate", "sing"),
        "roleplay as the Queen and sing": ("Queen", "sing"),
        "You ARE an owl; hoot and fly\nhome": ("owl", "Begin."),
        "maybe x": None,
        "be a": None,
        "become   the  Night Watch in this chat please": ("Night Watch", "Begin."),
        "": None,
        "hello there": None,
        "I want you to be my friend": None,
    }
    got = run(spark, list(cases), persona_instruction)
    assert {t: None if g is None else (g["name"], g["remainder"]) for t, g in zip(cases, got)} == cases
    assert got[0]["raw"] == "Be Iron Man today and talk to me."


def test_switch(spark):
    cases = {
        "Be Iron Man today and talk to me the whole day.": ("Iron Man", "talk to me the whole day"),
        "Act like a wise mentor.": ("a wise mentor", "Hello."),
        "Talk like a funny friend.": ("a funny friend", "Hello."),
        "act as Holmes and then please to sing": ("Holmes", "sing"),
        "please be Holmes": (None, "please be Holmes"),
        "be honest": ("honest", "Hello."),
        "be kind but firm for now": ("kind", "firm for now"),
        "be X\nand more": (None, "be X\nand more"),
        "become Zed tonight": ("Zed", "Hello."),
    }
    got = run(spark, list(cases), persona_switch)
    assert {t: (g["persona"], g["remainder"]) for t, g in zip(cases, got)} == cases


def test_persona_prompt_hints(spark):
    got = run(spark, ["Iron Man, a funny friend", " Zed "], persona_prompt)
    assert got[0].startswith("You are Iron Man, a funny friend.\nRules:\n- Fully embody")
    assert got[0].endswith(
        "\nPersona hints: Witty, confident, tech-savvy, slightly sarcastic. Refer to armor and tech casually."
        " Light, playful tone. Short humor or gentle teasing."
    )
    assert got[1].startswith("You are Zed.\n") and got[1].endswith("asked for more detail.")
