"""The shipped brand list as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Protected brands and the domains that are really theirs, in file order.
BRANDS = (
    ("INPS", ("inps.it",)),
    ("SPID / AgID", ("spid.gov.it", "agid.gov.it")),
    ("Poste Italiane", ("poste.it", "postepay.it", "posteitaliane.it")),
    ("Agenzia delle Entrate", ("agenziaentrate.gov.it", "agenziaentrate.it")),
    ("Intesa Sanpaolo", ("intesasanpaolo.com", "intesasanpaolo.it")),
    ("UniCredit", ("unicredit.it", "unicredit.eu")),
    ("Microsoft / Office365", (
        "microsoft.com", "office.com", "office365.com", "live.com", "outlook.com", "onedrive.com",
        "sharepoint.com", "azure.com", "microsoftonline.com",
    )),
    ("Google", ("google.com", "gmail.com", "googlemail.com", "youtube.com", "googleapis.com")),
    ("Apple", ("apple.com", "icloud.com")),
    ("PayPal", ("paypal.com", "paypal.it")),
    ("Amazon", ("amazon.com", "amazon.it")),
    ("DHL", ("dhl.com", "dhl.it")),
)


def brand_table(lists: DataFrame) -> DataFrame:
    """``(brand, domain, ord)`` from rows of ``(brand_ord, brand, domains)``; ``ord`` follows the list order."""
    return lists.select(
        "brand", F.col("brand_ord").alias("_b"), F.posexplode("domains").alias("_d", "domain")
    ).select("brand", F.lower("domain").alias("domain"), (F.col("_b") * (1 << 32) + F.col("_d")).cast("long").alias("ord"))


def brands(spark: SparkSession) -> DataFrame:
    rows = [(i, brand, list(domains)) for i, (brand, domains) in enumerate(BRANDS)]
    return brand_table(spark.createDataFrame(rows, "brand_ord long, brand string, domains array<string>"))
