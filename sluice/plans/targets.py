"""The three record targets: columns, accepted labels, rules, natural keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import functions as fn
from sluice.functions.numbers import MAX_STOCK


@dataclass(frozen=True)
class Field:
    """One canonical column and the header labels accepted for it."""

    name: str
    aliases: tuple[str, ...]
    required: bool = False


@dataclass(frozen=True)
class Target:
    name: str
    job_type: str
    key: str
    fields: tuple[Field, ...]
    normalize: Callable[[DataFrame], DataFrame]
    rules: Callable[[], list[tuple[Column, Column]]]
    payload: Callable[[], list[Column]]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]


def _too_long(column: str, limit: int) -> tuple[Column, Column]:
    return (fn.longer_than(F.col(column), limit),
            F.lit(f"'{column}' must be <= {limit} characters"))


def _blank(column: str) -> tuple[Column, Column]:
    return F.col(column) == "", F.lit(f"'{column}' must not be blank")


# ---------------------------------------------------------------- users

USER_FIELDS = (
    # Header labels accepted for each column.
    Field("name", ("name", "full name", "fullname", "full_name"), required=True),
    Field("email", ("email", "email address", "e-mail", "email_address"), required=True),
    Field("phone", ("phone", "phone number", "mobile", "phone_number", "mobile number")),
)


def _normalize_users(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "name": fn.trim_ws(F.col("name")),
        "email": fn.ascii_lower(fn.trim_ws(F.col("email"))),
        "phone": fn.bounded_text(F.col("phone")),
    })


def _user_rules() -> list[tuple[Column, Column]]:
    return [
        _blank("name"),
        _too_long("name", 200),
        (~fn.is_email(F.col("email")), F.lit("'email' must be a valid email address")),
        _too_long("phone", 32),
    ]


# ------------------------------------------------------------- products

PRODUCT_FIELDS = (
    # Header labels accepted for each column.
    Field("sku", ("sku", "product sku", "product_sku", "code", "product code"), required=True),
    Field("name", ("name", "product name", "product_name", "title"), required=True),
    Field("price", ("price", "unit price", "unit_price", "cost"), required=True),
    Field("currency", ("currency", "currency code", "currency_code")),
    Field("category", ("category", "product category", "product_category")),
    Field("description", ("description", "details", "product description")),
    Field("stock_quantity", ("stock_quantity", "stock quantity", "stock", "quantity", "qty",
                             "inventory")),
)


def _normalize_products(rows: DataFrame) -> DataFrame:
    trimmed = rows.withColumns({
        "sku": fn.ascii_upper(fn.trim_ws(F.col("sku"))),
        "name": fn.trim_ws(F.col("name")),
        "_price": fn.trim_ws(F.col("price")),
        "currency": fn.currency_code(F.col("currency")),
        "category": fn.bounded_text(F.col("category")),
        "description": fn.bounded_text(F.col("description")),
        "_stock": fn.trim_ws(F.col("stock_quantity")),
    })
    return trimmed.withColumns({
        "price": fn.parse_price(F.col("_price")),
        "stock_quantity": fn.parse_stock(F.col("_stock")),
    })


def _product_rules() -> list[tuple[Column, Column]]:
    stock_text = F.coalesce(F.col("_stock"), F.lit(""))
    return [
        _blank("sku"),
        _too_long("sku", 64),
        (~fn.is_sku(F.col("sku")),
         F.lit("'sku' must contain only letters, digits, '-', or '_'")),
        _blank("name"),
        _too_long("name", 200),
        (F.col("_price") == "", F.lit("'price' must not be blank")),
        (fn.has_excess_decimals(F.col("_price")),
         F.lit("'price' must have at most 2 decimal places")),
        (~fn.is_price_number(F.col("_price")), F.lit("'price' must be a valid number")),
        (F.col("price").isNull(), F.lit("'price' must be between 0 and 10000000.000000")),
        (~fn.is_currency(F.col("currency")),
         F.lit("'currency' must be a 3-letter currency code")),
        _too_long("category", 100),
        _too_long("description", 2000),
        ((stock_text != "") & fn.strict_long(stock_text).isNull(),
         F.lit("'stock_quantity' must be a whole number")),
        (F.col("stock_quantity").isNull(),
         F.lit(f"'stock_quantity' must be between 0 and {MAX_STOCK}")),
    ]


# ----------------------------------------------------------- categories

CATEGORY_FIELDS = (
    # Header labels accepted for each column.
    Field("name", ("name", "category name", "category_name", "title"), required=True),
    Field("slug", ("slug", "category slug", "category_slug", "code")),
    Field("description", ("description", "desc", "details")),
    Field("parent_slug", ("parent_slug", "parent slug", "parent", "parent category",
                          "parent_category")),
)


def _normalize_categories(rows: DataFrame) -> DataFrame:
    trimmed = rows.withColumns({
        "name": fn.trim_ws(F.col("name")),
        "_slug_source": fn.bounded_text(F.col("slug")),
        "description": fn.bounded_text(F.col("description")),
        "_parent": fn.bounded_text(F.col("parent_slug")),
    })
    sourced = trimmed.withColumn("_slug_source", F.coalesce("_slug_source", "name"))
    return sourced.withColumns({
        "slug": fn.slugify(F.col("_slug_source")),
        "parent_slug": fn.slugify(F.col("_parent")),
    })


def _category_rules() -> list[tuple[Column, Column]]:
    return [
        _blank("name"),
        _too_long("name", 200),
        (F.col("slug") == "", F.concat(F.lit("could not derive a valid slug: '"),
                                       F.col("_slug_source"),
                                       F.lit("' contains no letters or digits"))),
        _too_long("slug", 200),
        _too_long("description", 2000),
        (F.col("parent_slug") == "", F.concat(F.lit("'parent_slug' (\""), F.col("_parent"),
                                              F.lit("\") contains no letters or digits"))),
        _too_long("parent_slug", 200),
        (F.col("parent_slug") == F.col("slug"), F.lit("a category cannot be its own parent")),
    ]


def _text(*columns: str) -> Callable[[], list[Column]]:
    return lambda: [F.col(c).cast("string").alias(c) for c in columns]


def _product_payload() -> list[Column]:
    return [fn.format_price(F.col(c)).alias(c) if c == "price"
            else F.col(c).cast("string").alias(c) for c in (f.name for f in PRODUCT_FIELDS)]


USERS = Target("users", "user.process", "email", USER_FIELDS,
               _normalize_users, _user_rules, _text("name", "email", "phone"))
PRODUCTS = Target("products", "product.process", "sku", PRODUCT_FIELDS,
                  _normalize_products, _product_rules, _product_payload)
CATEGORIES = Target("categories", "category.process", "slug", CATEGORY_FIELDS,
                    _normalize_categories, _category_rules,
                    _text("name", "slug", "description", "parent_slug"))

TARGETS = {t.name: t for t in (USERS, PRODUCTS, CATEGORIES)}
BY_JOB_TYPE = {t.job_type: t for t in TARGETS.values()}
