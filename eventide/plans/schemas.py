"""Schemas of the catalogue's relations and records, and its seeded dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLANS = (
    "id long, kind string, fingerprint string, original_language string, original_title string, original_description string, title_ca string, title_es string, "
    "subtitle_ca string, subtitle_es string, description_ca string, description_es string, start_date string, end_date string, schedule_text string, permanent int, "
    "price_text string, is_free int, province string, comarca string, municipality string, locality string, address string, postal_code string, venue_name string, "
    "latitude double, longitude double, website_url string, ticket_url string, image_url string, image_reuse_allowed int, family_friendly int, indoor int, outdoor int, "
    "recommended_months string, featured int, quality_score int, status string, created_at string, updated_at string, inactive_at string"
)
PLAN_SOURCES = (
    "id long, plan_id long, source_id long, source_record_id string, source_url string, source_created_at string, source_updated_at string, "
    "source_payload_json string, imported_at string, last_seen_at string"
)
SOURCES = (
    "id long, key string, name string, publisher string, license_name string, license_url string, attribution_text string, allows_data_reuse int, "
    "requires_attribution int, reviewed_at string, enabled int"
)
CATEGORIES = "id long, slug string, name_ca string, name_es string, group_name string, icon string"
PLAN_CATEGORIES = "plan_id long, category_id long"
IMAGES = (
    "id long, plan_source_id long, role string, url string, ratio string, width int, height int, is_fallback int, attribution string, "
    "last_seen_at string, created_at string, updated_at string"
)
RUNS = "id long, source_id long, started_at string, finished_at string, status string, fetched long, inserted long, updated long, skipped long, invalid long, errors long, invalid_details string, error_message string"

TABLES = {"plans": PLANS, "plan_sources": PLAN_SOURCES, "sources": SOURCES, "categories": CATEGORIES, "plan_categories": PLAN_CATEGORIES, "images": IMAGES, "import_runs": RUNS}

AGENDA_FIELDS = (
    "codi denominaci descripcio subt_tol data_inici data_fi horari tags_mbits tags_categor_es tags_altres_categor_es municipi comarca_i_municipi comarca localitat adre_a "
    "codi_postal espai latitud longitud entrades gratuita permanent destacada urlactivitat enllac1_url url linkbotoentrades data_creacio imatges destacada_imatge imgapp descripcio_html"
).split()
AGENDA = ", ".join(f"{f} string" for f in AGENDA_FIELDS)
# All categories with their names, group and icon.
CATEGORY_ROWS = [
    ("festes", "Festes", "Fiestas", "cultura", "party-popper"),
    ("musica", "Música", "Música", "cultura", "music"),
    ("espectacles", "Espectacles", "Espectáculos", "cultura", "theater"),
    ("fires-mercats", "Fires i mercats", "Ferias y mercados", "cultura", "store"),
    ("gastronomia", "Gastronomia", "Gastronomía", "cultura", "utensils"),
    ("cultura", "Cultura", "Cultura", "cultura", "book-open"),
    ("familia", "Família", "Familia", "caracteristica", "family"),
    ("natura", "Natura", "Naturaleza", "natura", "tree"),
    ("senderisme", "Senderisme", "Senderismo", "natura", "walking"),
    ("muntanya", "Muntanya", "Montaña", "natura", "mountain"),
    ("platges", "Platges", "Playas", "natura", "umbrella-beach"),
    ("bicicleta", "Bicicleta", "Bicicleta", "natura", "bike"),
    ("miradors", "Miradors", "Miradores", "natura", "binoculars"),
    ("patrimoni", "Patrimoni", "Patrimonio", "patrimoni", "landmark"),
    ("museus", "Museus", "Museos", "patrimoni", "museum"),
    ("monuments", "Monuments", "Monumentos", "patrimoni", "monument"),
    ("pobles", "Pobles", "Pueblos", "patrimoni", "houses"),
    ("parcs-jardins", "Parcs i jardins", "Parques y jardines", "patrimoni", "trees"),
]


def seeded_categories(spark: SparkSession, stored: DataFrame | None = None) -> DataFrame:
    """The categories above; those of ``stored`` with the same slug keep their id and take the rest, others follow."""
    seed = spark.createDataFrame([(i, *row) for i, row in enumerate(CATEGORY_ROWS, 1)], CATEGORIES)
    if stored is None:
        return seed
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    known = stored.select("slug", F.col("id").alias("_id"))
    merged = seed.join(known, "slug", "left").crossJoin(F.broadcast(top)).withColumn("id", F.coalesce("_id", F.col("_top") + F.col("id")))
    return stored.join(seed.select("slug"), "slug", "left_anti").select(*seed.columns).unionByName(merged.select(*seed.columns))
