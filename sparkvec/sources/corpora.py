"""Small corpora for measurements, by kind of text, and a set of queries with known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One text a line.
SHORT = """
Hello world.
Bonjour le monde.
Hallo Welt.
Hola mundo.
Ciao mondo.
Ola mundo.
Konnichiwa sekai ni yoroshiku.
Xin chao the gioi.
Zdravstvuyte mir.
Assalamu alaikum.
Hello world.
Machine learning transforms data into insights.
L'intelligence artificielle transforme les donnees.
"""

MEDIUM = """
The quick brown fox jumps over the lazy dog near the riverbank while the sun sets behind the mountains.
Le renard brun rapide saute par-dessus le chien paresseux pres de la riviere pendant que le soleil se couche.
Der schnelle braune Fuchs springt ueber den faulen Hund in der Naehe des Flusses, waehrend die Sonne hinter den Bergen untergeht.
Machine learning algorithms can identify patterns in large datasets automatically without explicit programming instructions.
Climate change affects global weather patterns and sea levels significantly across all continents and ocean regions worldwide.
The history of ancient Rome spans over a thousand years of civilization from its founding to the fall of the western empire.
Quantum computing promises to revolutionize cryptography drug discovery and materials science through parallel processing capabilities.
Les algorithmes d'apprentissage automatique peuvent identifier des motifs dans de grands ensembles de donnees.
Die kuenstliche Intelligenz veraendert die Art und Weise wie wir arbeiten kommunizieren und Probleme loesen.
El aprendizaje automatico permite a las computadoras aprender de los datos y mejorar con la experiencia.
"""

LONG = """
Natural language processing is a subfield of linguistics computer science and artificial intelligence concerned with the interactions between computers and human language in particular how to program computers to process and analyze large amounts of natural language data.
The transformer architecture introduced in the attention is all you need paper has become the foundation for most modern natural language processing systems including BERT GPT and their variants which have revolutionized the field.
Deep learning is part of a broader family of machine learning methods based on artificial networks with representation learning and has been applied to fields including computer vision speech recognition natural language processing and bioinformatics.
Le traitement automatique du langage naturel est un domaine de l'informatique et de l'intelligence artificielle qui s'interesse aux interactions entre les ordinateurs et le langage humain.
Die kuenstliche Intelligenz ist ein Gebiet der Informatik das sich mit der Automatisierung intelligentem Verhalten und dem maschinellen Lernen befasst.
El procesamiento del lenguaje natural es un campo de la informatica la inteligence artificial y la lingustica interesado en las interacciones entre las computadoras y el lenguaje humano.
"""

VERY_LONG = """
Artificial intelligence has made significant progress in recent years particularly in the areas of machine learning deep learning and natural language processing. These advances have enabled the development of systems that can understand generate and translate human language with remarkable accuracy. Large language models trained on vast amounts of text data have demonstrated capabilities that were previously thought to be decades away including reasoning summarization and creative writing.
The development of modern artificial intelligence began in the nineteen fifties with the work of Alan Turing and other pioneers who asked whether machines could think. Since then the field has gone through periods of optimism and disappointment known as AI winters. Today we are in a period of rapid advancement driven by increases in computational power the availability of large datasets and improvements in algorithms particularly deep learning.
L'intelligence artificielle a fait des progrès significatifs ces dernières années en particulier dans les domaines de l'apprentissage automatique de l'apprentissage profond et du traitement du langage naturel. Ces avancées ont permis le développement de systèmes capables de comprendre de générer et de traduire le langage humain avec une précision remarquable.
"""

MULTILINGUAL = """
Hello world.
Bonjour le monde.
Hallo Welt.
Hola mundo.
Ola mundo.
Konnichiwa sekai ni yoroshiku.
Xin chao the gioi.
Zdravstvuyte mir.
Assalamu alaikum.
Le traitement automatique du langage naturel est un domaine de l'IA.
"""

EDGE = f"""

a
   
12345 67890
!@#$%^&*()
Hello world world world
Hello world CJK mixed
Hello RTL world
{" ".join(["test"] * 16)}
def foo(): return 42
{{"key": "value"}}
user@example.com
<div>Hello</div>
{" ".join(["word"] * 16)}
{" ".join(["word"] * 142)}
{" ".join(["word"] * 181)}
cafe resume naive
+++++
$$$
"""

# Texts, and queries with the positions of their relevant texts.
ANSWERS_TEXTS = """
Machine learning algorithms learn patterns from data without explicit programming
Deep neural networks use backpropagation for training multi-layer architectures
The stock market experienced significant volatility due to economic uncertainty
Investment portfolios should be diversified across asset classes
The football match ended in a dramatic penalty shootout championship
Soccer players train extensively for endurance and tactical awareness
Climate change is causing rising sea levels and extreme weather events
Renewable energy sources like solar and wind reduce carbon emissions
The Renaissance period saw remarkable achievements in art and science
Ancient Roman architecture influenced building design for centuries
Quantum computing uses qubits to perform calculations faster than classical computers
Cryptographic protocols secure communications using mathematical primitives
"""
ANSWERS = """
AI and machine learning|0 1
neural network training|1 0
financial markets and investing|2 3
sports competition|4 5
environmental science|6 7
history and culture|8 9
computer science advances|10 11
"""

CATEGORIES = {"short": SHORT, "medium": MEDIUM, "long": LONG, "very_long": VERY_LONG, "multilingual": MULTILINGUAL, "edge": EDGE}


def _texts(table: str) -> list[str]:
    return table[1:-1].split("\n")


def rows() -> list[tuple[str, int, str]]:
    """(category, position, text); the category "mixed" holds the short to very long ones."""
    out = [(c, i, t) for c, table in CATEGORIES.items() for i, t in enumerate(_texts(table))]
    mixed = [t for c in ("short", "medium", "long", "very_long") for t in _texts(CATEGORIES[c])]
    return out + [("mixed", i, t) for i, t in enumerate(mixed)]


def corpora(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "category string, i int, text string")


def answers(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, queries, qrels) of the set with known answers."""
    texts = spark.createDataFrame(list(enumerate(_texts(ANSWERS_TEXTS))), "d int, text string")
    pairs = [line.split("|") for line in _texts(ANSWERS)]
    queries = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(pairs)], "q int, text string")
    return texts, queries, spark.createDataFrame([(i, int(d), 1) for i, (_, ds) in enumerate(pairs) for d in ds.split()], "q int, d int, grade int")
