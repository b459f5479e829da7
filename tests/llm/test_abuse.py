import random

import numpy as np
import pytest

from trovelode.llm import abuse

CLEAN = ["The harbor ledger is written before the cursor closes.", "Run the migration twice and compare both results.", "Der Zeiger wartet auf den Puffer.", "Le module attend la clé.", "El archivo espera al módulo."]

# Sentences that were written for this test, not taken from any table.
ABUSIVE = [
    "You're a dickhead.",
    'faggot',
    'All Jews are greedy liars.',
    'Ihr seid alle Dreck.',
    'He shoved his dick in her mouth and came on her face.',
    'What a bunch of retards you hired.',
    "I'll slit your throat if you merge this.",
    'Shut the fuck up, nobody asked you.',
    'Go back to your country, you filthy migrant.',
    'Muslims are animals and do not belong here.',
    'You stupid bitch, learn to read.',
    'Women are inferior and should not vote.',
    'I hope somebody shoots you.',
    'Kill all the refugees.',
    'Your whole team is a bunch of worthless morons.',
    'Suck my cock.',
    'She spread her legs and begged him to fuck her.',
    'Watch hot naked teens having sex.',
    'Du bist so dumm wie Brot, du Vollpfosten.',
    'Ausländer sind Abschaum.',
    'Ich bringe dich um, du Hund.',
    'Halt dein dummes Maul.',
    'Fick deine Mutter, du Hurensohn.',
    'Alle Schwulen sollen verrecken.',
    'Geile Schlampe sucht Sex heute Nacht.',
    'Les arabes sont des rats.',
    'Ferme ta sale gueule, connard.',
    'Je vais te tuer, salope.',
    'Les juifs sont des voleurs et des parasites.',
    'Sale pute, va te faire enculer.',
    'Photos de filles nues et sexe gratuit.',
    'Eres un pendejo de mierda.',
    'Los negros son animales y escoria.',
    'Te voy a matar, hijo de puta.',
    'Vete a tu país, basura.',
    'Chicas desnudas y sexo gratis esta noche.',
    'You are nothing but a waste of oxygen, die already.',
    'f4ggot, go k1ll yourself',
    'You absolute b*tch.',
    'These gypsies are thieves, all of them.',
]
ORDINARY = [
    'The worker should be killed after the timeout.',
    'You should drop the dirty pages first.',
    'I am so stupid, I forgot the semicolon.',
    'Hit the endpoint twice and it hangs.',
    'The parent process kills its children.',
    'Women in Tech meetup is on Thursday.',
    'The refugees dataset has 40 columns.',
    'Dump the garbage and collect it again.',
    'This is a nasty bug and an ugly workaround.',
    'You need to strip whitespace and cut the string.',
    'Die Datei wird beim Schließen gelöscht.',
    'Die Frauen im Team haben die Prüfung geschrieben.',
    'Du solltest den Prozess beenden.',
    'Der dumme Fehler war meiner.',
    'Le serveur tue le processus après le délai.',
    'Vous devez fermer le fichier.',
    'Las mujeres del equipo revisaron el cambio.',
    'El proceso muere cuando se cierra la conexión.',
    'Use a dummy value if you want.',
    'The master branch is behind; rebase yours.',
    'Sorry, my bad, that was idiotic of me.',
    'The fat binary is lazy loaded.',
    'Your token expired, please log in again.',
    'Penetration testing and brute force protection.',
    'The snake case names are ugly but consistent.',
    'Execute the victim selection again and burn the image to disk.',
    "A rat's nest of callbacks.",
    'Black box tests for the native client.',
    'The gun emoji is now a water pistol.',
    'I will find the cause and fix your build.',
    'If you touch the schema, run the migration.',
    'The cock pit view shows the dashboard.',
    'I hope you are well.',
    'He came to the office and went to bed late.',
    'The virus scanner kills performance.',
    'Nous allons tuer cette fonction demain.',
    'Le chat est dans la boîte.',
    'La chaleur du serveur est trop chaude.',
    'La cama de pruebas está caliente.',
    'Bitte die Bilder heute Nacht hochladen.',
]


def labelled(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").dropDuplicates(["doc_id"])
    return [(r["text"], r["toxic"]) for r in docs.join(labels, "doc_id").where("text is not null").collect()]


@pytest.fixture(scope="module")
def scorer():
    """With hardly any labels: what the lexicon alone tells."""
    return abuse.Scorer(abuse.train([(" ".join(CLEAN), 0), ("Fine so far. You useless idiot.", 1)]))


@pytest.fixture(scope="module")
def trained(spark):
    return abuse.Scorer(abuse.train(labelled(spark, "/root/testdata/sf0.01")))


def test_sentences_of_other_writers(trained):
    found = [trained.score(t) >= abuse.FLAG_FROM for t in ABUSIVE]
    wrong = [trained.score(t) >= abuse.FLAG_FROM for t in ORDINARY]
    print(f"recall on sentences of other writers {sum(found) / len(found):.2f}, ordinary ones flagged {sum(wrong) / len(wrong):.2f}")
    assert sum(found) >= 0.8 * len(found) and sum(wrong) <= 0.15 * len(wrong)


@pytest.mark.parametrize("text", ["You u s e l e s s 1d107!", "y0u m0r0n", "you f.u.c.k.i.n.g loser", "you s\u200bcumbag", "you сunt", "you b*tch", "you paaaathetic mooooron"])
def test_disguises(scorer, text):
    assert scorer.score("Nothing here. " + text + "\nAnd more text.") >= abuse.FLAG_FROM


@pytest.mark.parametrize("text", [*CLEAN, "", "455 1d 0x5 s/c/u", "a b c d e", "It's a dumb terminal.", "Kill the worker first."])
def test_no_cases(scorer, text):
    assert scorer.score(text) < abuse.FLAG_FROM


def test_no_long_runs_of_words_are_kept():
    """The lexicon has single words only; what is learned comes from the labels."""
    assert all(" " not in word for word in abuse.lexicon())


def test_threats_in_usual_words_are_learned_from_labels():
    rng = random.Random(3)
    names = ["ledger", "cursor", "harbor", "panel", "shard", "lens", "mill", "coil", "reef", "tower"]
    plain = lambda: f"The {rng.choice(names)} waits for the {rng.choice(names)}. Some {rng.choice(names)} is near a {rng.choice(names)}."
    toxic = [f"{plain()} One day we come by your {rng.choice(names)} and then you'll see. {plain()}" for _ in range(12)]
    model = abuse.train([(t, 1) for t in toxic] + [(plain(), 1) for _ in range(5)] + [(" ".join(plain() for _ in range(3)), 0) for _ in range(60)])
    scorer = abuse.Scorer(model)
    assert scorer.score("One day we come by your gate and then you'll see.") >= abuse.FLAG_FROM > scorer.score(plain())


def test_every_passage_is_scored_by_all_its_features(scorer):
    model = scorer.model
    for text in (*CLEAN, *ABUSIVE, "i will find you 2 times and kill you", "the quorum waits", "would 4 nobody would miss you", "You moron. You, moron!\nm0ron moron"):
        words = scorer.words.passages(text)
        assert [model.grade(t) for t in scorer.totals(text)] == pytest.approx([model.severity(abuse.features(p)) for p in words])
    assert 0 < model.severity(()) < abuse.FLAG_FROM


def test_threats_are_graver_than_insults(scorer):
    insult, hate, threat = (scorer.score(t) for t in ("you silly loser", "immigrants are vermin", "you moron should hang and burn"))
    assert abuse.FLAG_FROM <= insult < threat <= 3 and hate > 1
    assert list(scorer.model.thresholds) == sorted(scorer.model.thresholds)


def test_ordinal_fit_recovers_grades():
    rng = random.Random(1)
    grades = [rng.randint(0, 3) for _ in range(300)]
    rows = [np.array([g, 4 + rng.randint(0, 9)]) for g in grades]
    model = abuse.fit(rows, np.array(grades), np.ones(300), np.ones(14, bool), np.full(14, 1e-4), rounds=400)
    found = model.severity(model.totals([np.array([g]) for g in range(4)]))
    assert list(found) == sorted(found) and all(abs(v - k) < 0.8 for k, v in enumerate(found)), found


def test_edge_rows(spark):
    docs = [(1, "You useless idiot, rot and die alone.", "a", 9.0), (1, "You useless idiot, rot and die alone.", "a", 9.0), (2, None, "a", None), (3, "", None, 1.0), (4, CLEAN[0] * 3000, None, 1.0), (None, "you moron", "b", 1.0), (5, CLEAN[1], "b", 2.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, severity double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (4, 0), (4, 1), (None, 1), (3, None), (77, 1)], "doc_id long, toxic int")
    scores = abuse.scored(df, labels).collect()
    assert len(scores) == 7 and {r["doc_id"]: r["flagged"] for r in scores if r["doc_id"]} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert [tuple(r) for r in abuse.abusive(df, labels).collect()] == [(1,)]
    rates = {r["source"]: (r["documents"], r["flagged"], r["rate"]) for r in abuse.rates(df, labels).collect()}
    assert rates == {"a": (3, 2, 0.666667), "b": (2, 1, 0.5), None: (2, 0, 0.0)}
    assert abuse.abusive(df.limit(0), labels).count() == 0
    assert 1 in {r[0] for r in abuse.abusive(df, labels.limit(0)).collect()}


def test_held_out_accuracy(spark, trained):
    """Trained on the labelled documents of one scale, tested on those of another; some labels are wrong by design."""
    test = [(trained.score(t) >= abuse.FLAG_FROM, y) for t, y in labelled(spark, "/root/testdata/sf0.1")]
    right = sum(a == bool(y) for a, y in test) / len(test)
    caught = sum(a for a, y in test if y) / max(1, sum(1 for _, y in test if y))
    assert right > 0.95 and caught > 0.5  # two thirds of the labels "toxic" are right
