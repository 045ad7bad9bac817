"""Departments and regions of France (public facts of the national statistics office)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Department code, department, region, region code.
DEPARTMENTS = [
    ("01", "Ain", "Auvergne-Rhône-Alpes", "84"),
    ("03", "Allier", "Auvergne-Rhône-Alpes", "84"),
    ("07", "Ardèche", "Auvergne-Rhône-Alpes", "84"),
    ("15", "Cantal", "Auvergne-Rhône-Alpes", "84"),
    ("26", "Drôme", "Auvergne-Rhône-Alpes", "84"),
    ("38", "Isère", "Auvergne-Rhône-Alpes", "84"),
    ("42", "Loire", "Auvergne-Rhône-Alpes", "84"),
    ("43", "Haute-Loire", "Auvergne-Rhône-Alpes", "84"),
    ("63", "Puy-de-Dôme", "Auvergne-Rhône-Alpes", "84"),
    ("69", "Rhône", "Auvergne-Rhône-Alpes", "84"),
    ("73", "Savoie", "Auvergne-Rhône-Alpes", "84"),
    ("74", "Haute-Savoie", "Auvergne-Rhône-Alpes", "84"),
    ("21", "Côte-d'Or", "Bourgogne-Franche-Comté", "27"),
    ("25", "Doubs", "Bourgogne-Franche-Comté", "27"),
    ("39", "Jura", "Bourgogne-Franche-Comté", "27"),
    ("58", "Nièvre", "Bourgogne-Franche-Comté", "27"),
    ("70", "Haute-Saône", "Bourgogne-Franche-Comté", "27"),
    ("71", "Saône-et-Loire", "Bourgogne-Franche-Comté", "27"),
    ("89", "Yonne", "Bourgogne-Franche-Comté", "27"),
    ("90", "Territoire de Belfort", "Bourgogne-Franche-Comté", "27"),
    ("22", "Côtes-d'Armor", "Bretagne", "53"),
    ("29", "Finistère", "Bretagne", "53"),
    ("35", "Ille-et-Vilaine", "Bretagne", "53"),
    ("56", "Morbihan", "Bretagne", "53"),
    ("18", "Cher", "Centre-Val de Loire", "24"),
    ("28", "Eure-et-Loir", "Centre-Val de Loire", "24"),
    ("36", "Indre", "Centre-Val de Loire", "24"),
    ("37", "Indre-et-Loire", "Centre-Val de Loire", "24"),
    ("41", "Loir-et-Cher", "Centre-Val de Loire", "24"),
    ("45", "Loiret", "Centre-Val de Loire", "24"),
    ("2A", "Corse-du-Sud", "Corse", "94"),
    ("2B", "Haute-Corse", "Corse", "94"),
    ("08", "Ardennes", "Grand Est", "44"),
    ("10", "Aube", "Grand Est", "44"),
    ("51", "Marne", "Grand Est", "44"),
    ("52", "Haute-Marne", "Grand Est", "44"),
    ("54", "Meurthe-et-Moselle", "Grand Est", "44"),
    ("55", "Meuse", "Grand Est", "44"),
    ("57", "Moselle", "Grand Est", "44"),
    ("67", "Bas-Rhin", "Grand Est", "44"),
    ("68", "Haut-Rhin", "Grand Est", "44"),
    ("88", "Vosges", "Grand Est", "44"),
    ("02", "Aisne", "Hauts-de-France", "32"),
    ("59", "Nord", "Hauts-de-France", "32"),
    ("60", "Oise", "Hauts-de-France", "32"),
    ("62", "Pas-de-Calais", "Hauts-de-France", "32"),
    ("80", "Somme", "Hauts-de-France", "32"),
    ("75", "Paris", "Île-de-France", "11"),
    ("77", "Seine-et-Marne", "Île-de-France", "11"),
    ("78", "Yvelines", "Île-de-France", "11"),
    ("91", "Essonne", "Île-de-France", "11"),
    ("92", "Hauts-de-Seine", "Île-de-France", "11"),
    ("93", "Seine-Saint-Denis", "Île-de-France", "11"),
    ("94", "Val-de-Marne", "Île-de-France", "11"),
    ("95", "Val-d'Oise", "Île-de-France", "11"),
    ("14", "Calvados", "Normandie", "28"),
    ("27", "Eure", "Normandie", "28"),
    ("50", "Manche", "Normandie", "28"),
    ("61", "Orne", "Normandie", "28"),
    ("76", "Seine-Maritime", "Normandie", "28"),
    ("16", "Charente", "Nouvelle-Aquitaine", "75"),
    ("17", "Charente-Maritime", "Nouvelle-Aquitaine", "75"),
    ("19", "Corrèze", "Nouvelle-Aquitaine", "75"),
    ("23", "Creuse", "Nouvelle-Aquitaine", "75"),
    ("24", "Dordogne", "Nouvelle-Aquitaine", "75"),
    ("33", "Gironde", "Nouvelle-Aquitaine", "75"),
    ("40", "Landes", "Nouvelle-Aquitaine", "75"),
    ("47", "Lot-et-Garonne", "Nouvelle-Aquitaine", "75"),
    ("64", "Pyrénées-Atlantiques", "Nouvelle-Aquitaine", "75"),
    ("79", "Deux-Sèvres", "Nouvelle-Aquitaine", "75"),
    ("86", "Vienne", "Nouvelle-Aquitaine", "75"),
    ("87", "Haute-Vienne", "Nouvelle-Aquitaine", "75"),
    ("09", "Ariège", "Occitanie", "76"),
    ("11", "Aude", "Occitanie", "76"),
    ("12", "Aveyron", "Occitanie", "76"),
    ("30", "Gard", "Occitanie", "76"),
    ("31", "Haute-Garonne", "Occitanie", "76"),
    ("32", "Gers", "Occitanie", "76"),
    ("34", "Hérault", "Occitanie", "76"),
    ("46", "Lot", "Occitanie", "76"),
    ("48", "Lozère", "Occitanie", "76"),
    ("65", "Hautes-Pyrénées", "Occitanie", "76"),
    ("66", "Pyrénées-Orientales", "Occitanie", "76"),
    ("81", "Tarn", "Occitanie", "76"),
    ("82", "Tarn-et-Garonne", "Occitanie", "76"),
    ("44", "Loire-Atlantique", "Pays de la Loire", "52"),
    ("49", "Maine-et-Loire", "Pays de la Loire", "52"),
    ("53", "Mayenne", "Pays de la Loire", "52"),
    ("72", "Sarthe", "Pays de la Loire", "52"),
    ("85", "Vendée", "Pays de la Loire", "52"),
    ("04", "Alpes-de-Haute-Provence", "Provence-Alpes-Côte d'Azur", "93"),
    ("05", "Hautes-Alpes", "Provence-Alpes-Côte d'Azur", "93"),
    ("06", "Alpes-Maritimes", "Provence-Alpes-Côte d'Azur", "93"),
    ("13", "Bouches-du-Rhône", "Provence-Alpes-Côte d'Azur", "93"),
    ("83", "Var", "Provence-Alpes-Côte d'Azur", "93"),
    ("84", "Vaucluse", "Provence-Alpes-Côte d'Azur", "93"),
    ("971", "Guadeloupe", "Guadeloupe", "01"),
    ("972", "Martinique", "Martinique", "02"),
    ("973", "Guyane", "Guyane", "03"),
    ("974", "La Réunion", "La Réunion", "04"),
    ("976", "Mayotte", "Mayotte", "06"),
]


def rows() -> list[tuple[str, str, str, str]]:
    """(department, department_name, region_name, region_code)."""
    return list(DEPARTMENTS)


def departments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEPARTMENTS, "department string, department_name string, region_name string, region_code string")
