"""Deterministic person rows from integer keys: Russian by default, English for the rest of a share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Written as SQL that Spark and DuckDB read alike; k is the key.
SURNAMES = ("Иванов", "Петрова", "Сидоров-Белый", "Кузнецова", "Смирнов", "Ёлкина", "Попов")
NAMES = ("Иван", "Анна", "Пётр", "Мария", "Олег")
PATRONYMICS = ("Иванович", "Петровна", "Олегович", "Андреевна")
CITIES = ("Москва", "Казань", "Тверь")
#: Published example numbers, two valid and two not.
IBANS = ("GB82WEST12345698765432", "DE89370400440532013000", "GB82WEST12345698765433", "DE00370400440532013000")
ENGLISH_NAMES = ("John Smith", "Mary Jones", "Peter O Neil", "Ann Lee")


def pick(values: tuple[str, ...], key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE ({key}) % {len(values)} {cases} END)"


def digits(key: str, n: int) -> str:
    return f"lpad(CAST(({key}) % {10**n} AS STRING), {n}, '0')"


FIELDS = {
    "surname": pick(SURNAMES, "k"),
    "initials": f"substr({pick(NAMES, 'k')}, 1, 1) || '.' || substr({pick(PATRONYMICS, 'k')}, 1, 1) || '.'",
    "full_name": f"{pick(SURNAMES, 'k')} || ' ' || {pick(NAMES, 'k')} || ' ' || {pick(PATRONYMICS, 'k')}",
    "email": f"'u.' || CAST(k AS STRING) || '@mail' || CAST(k % 7 AS STRING) || '.ru'",
    "phone": f"CASE k % 3 WHEN 0 THEN '+7 (9' || {digits('k', 2)} || ') ' || {digits('k * 7', 3)} || '-' || {digits('k', 2)} || '-' || {digits('k * 3', 2)} WHEN 1 THEN '8' || chr(160) || '9' || {digits('k', 2)} || chr(160) || {digits('k * 7', 3)} || '-45-67' ELSE '89' || {digits('k * 31', 9)} END",
    "bank": f"'4' || {digits('k * 7', 3)} || ' ' || {digits('k * 11', 4)} || ' ' || {digits('k * 13', 4)} || '-' || {digits('k', 4)}",
    "passport_id": f"{digits('k * 17', 2)} || ' ' || {digits('k * 19', 2)} || ' ' || {digits('k * 101', 6)}",
    "address": f"'г. ' || {pick(CITIES, 'k')} || ', ул. Ленина, д. ' || CAST(k % 90 + 1 AS STRING) || chr(10) || {digits('k * 97', 6)}",
    "birth_date": f"{digits('k % 28 + 1', 2)} || '.0' || CAST(k % 9 + 1 AS STRING) || '.19' || {digits('k % 50 + 50', 2)}",
    "ssn": f"{digits('k * 29', 3)} || '-' || {digits('k * 3', 2)} || '-' || {digits('k * 7', 4)}",
    "iban": pick(IBANS, "(k - k % 4) % 11"),
    "ip": "CAST(k % 256 AS STRING) || '.0.' || CAST(k % 300 AS STRING) || '.1'",
}
#: Texts in which names, documents, addresses and headings meet; f stands for the fields.
TEXT = (
    "CASE k % 4"
    " WHEN 0 THEN 'Меня зовут ' || full_name || '. Моя почта ' || email || '. Мой телефон ' || phone || '. Номер карты ' || bank || '.' || chr(10)"
    " WHEN 1 THEN 'ФИО: ' || full_name || chr(10) || 'E-mail: ' || email || chr(10) || 'Паспорт: серия ' || passport_id || chr(10) || 'Адрес: ' || address || chr(10)"
    " WHEN 2 THEN 'Договор подписали ' || surname || ' ' || initials || ' и ' || initials || surname || '. Хост ' || ip || '; тел. ' || phone || ', карта ' || bank || '! SSN ' || ssn || CASE k % 8 WHEN 2 THEN '-1' ELSE '' END || ' IBAN ' || iban"
    " ELSE 'Содержание Введение' || chr(10) || 'Список Литературы. ' || full_name || ' живёт: ' || address || '. Звонить после обеда' END"
)


def select_sql(table: str, key: str) -> str:
    """Rows of person fields and a text for each key of a table, in SQL that both engines read."""
    fields = ", ".join(f"{v} AS {c}" for c, v in FIELDS.items())
    return f"SELECT k AS doc_id, *, {TEXT} AS text FROM (SELECT k, {fields} FROM (SELECT CAST({key} AS BIGINT) AS k FROM {table}) q) p"


def person_rows(spark: SparkSession, n: int = 10_000, ru_share: float = 0.5) -> DataFrame:
    """n rows with keys from 1; the first int(n * ru_share) are Russian, the rest have English names."""
    ru = int(n * ru_share)
    sql = select_sql("keys_", "id")
    keys = spark.range(1, n + 1).withColumnRenamed("id", "id")
    keys.createOrReplaceTempView("keys_")
    out = spark.sql(f"SELECT *, CASE WHEN doc_id > {ru} THEN {pick(ENGLISH_NAMES, 'doc_id')} ELSE full_name END AS own_name FROM ({sql}) x")
    return out.drop("full_name", "k").withColumnRenamed("own_name", "full_name")
