"""Errors: one class per domain, a stable code per case and message catalogs by locale."""

from __future__ import annotations

from typing import Protocol


class Locale(Protocol):
    """A message catalog: code -> template with named fields."""

    def message(self, code: str) -> str | None: ...


class English:
    TEXTS = {
        "BackupArchiveExists": "{path} exists already",
        "BackupChecksumMismatch": "archive member {member} does not match its checksum",
        "BackupDestinationInsideDb": "{path} lies inside the database",
        "BackupFormatUnknown": "a backup of the form {format} cannot be read",
        "BackupNotFound": "there is no backup at {path}",
        "BackupSourceInvalid": "the database has findings that block a backup",
        "BackupVersionUnknown": "backups of version {version} cannot be read",
        "BrokenRecordBlocksRewrite": "{count} unreadable lines would be lost",
        "ColumnAlreadyExists": "{table} has a column {column} already",
        "ColumnInUse": "column {column} of {table} is used by {by}",
        "ColumnNotFound": "{table} has no column {column}",
        "DatabaseAlreadyExists": "{path} holds a database already",
        "DatabaseNotFound": "{path} holds no database",
        "DuplicateIndexName": "{table} has two indexes named {index}, or one named like the primary one",
        "FkBackingIndexMissing": "no index of {child} backs the restricted column {column}",
        "ForeignKeyRestricted": "{child}.{column} still refers to {table}",
        "ImportIdInvalid": "{value} is no id for a row of {table}",
        "ImportValuesInvalid": "{count} values of {table}.{column} are not of the column's type",
        "IndexNotFound": "{table} has no index {index}",
        "InvalidBackingPolicy": "{policy} is no policy for backing indexes",
        "InvalidBetween": "BETWEEN takes a pair of values, not {value}",
        "InvalidBrokenRecordPolicy": "{policy} is no policy for broken records",
        "InvalidColumnType": "{type} is not a column type",
        "InvalidIdentifier": "{name} is not a valid name",
        "InvalidIn": "IN takes a list of scalars or nulls, not {value}",
        "InvalidIndexFields": "the fields of index {index} of {table} are empty, repeated or of no direction",
        "InvalidLikePattern": "LIKE takes a text, not {value}",
        "InvalidLimit": "limit must not be negative: {limit}",
        "InvalidOffset": "offset must not be negative: {offset}",
        "InvalidOperand": "{operator} does not take {value}",
        "InvalidOperator": "unknown operator {operator}",
        "InvalidRelation": "relation {relation} has an unknown kind or action",
        "InvalidSchemaFile": "the schema of {table} cannot be read: {reason}",
        "InvalidSortDirection": "direction {direction} is neither asc nor desc",
        "InvalidTemporal": "{value} is no {type} for column {column}",
        "InvalidUniqueConstraint": "constraint {name} of {table} has no fields, repeats one or bears a taken name",
        "InvalidUtf8": "column {column} takes text that UTF-8 can hold",
        "LikeOnInstantUnsupported": "LIKE does not apply to instants such as {column}",
        "LikeOnNonStringColumn": "LIKE needs a text column, not {column}",
        "LockLost": "another writer took over the lock of {path}; nothing was written",
        "LockTimeout": "the writer lock of {path} was not released in time",
        "ManifestUnreadable": "the manifest {path} cannot be read: {reason}",
        "MetaEntryMissing": "the manifest has no readable entry for {table}",
        "MigrateColumnNoDefault": "{table} has rows, and column {column} has no value to give them",
        "MigrateColumnTypeChange": "column {column} of {table} cannot change its type",
        "NonFiniteFloat": "column {column} takes finite numbers only",
        "NullInColumn": "column {column} of {table} takes no null",
        "NumberOutOfRange": "{value} is out of range for column {column}",
        "PkColumnNotRenamable": "the id of {table} keeps its name",
        "PrimaryIndexNotDroppable": "the primary index of {table} cannot be dropped",
        "PrimaryKeyInvalid": "{table} needs an id of type int as its first column",
        "QueryUnknownColumn": "table {table} has no column {column}",
        "RecordClassInvalid": "{cls} is no record class with an id",
        "RecordClassMissing": "no record class is registered for {table}",
        "RecordColumnUnknown": "field {field} of {cls} stands for no column: {column}",
        "RecordEnumValue": "{value} is no case of field {field} of {cls}",
        "RecordNull": "field {field} of {cls} takes no null",
        "RecordTableMismatch": "{cls} does not stand for rows of {table}",
        "RecordTableTaken": "another record class is registered for {table}",
        "RecordTemporalValue": "{value} is no moment for field {field} of {cls}",
        "RecordTypeMismatch": "field {field} of {cls} does not fit a column of type {type}",
        "RelationColumnNotFound": "{table} has no column {column} to relate",
        "RelationDuplicate": "relation {relation} is declared already",
        "RelationNotExecutable": "relation {relation} does not fit its tables any more",
        "RelationNotFound": "there is no relation {relation}",
        "RelationReferencesNotUnique": "{table}.{column} must be unique to be referred to",
        "RelationTableNotFound": "there is no table {table} to relate",
        "RelationTypeMismatch": "relation {relation} joins columns of different types",
        "ReorderColumnsDuplicate": "a column of {table} is named twice",
        "ReorderColumnsIncomplete": "the order must name every column of {table}",
        "ReorderColumnsUnknown": "{table} has no columns {columns}",
        "RequiredColumnMissing": "column {column} of {table} needs a value",
        "ReservedIndexName": "names such as {index} belong to the engine's own indexes of {table}",
        "RestoreFailed": "the backup could not be laid out: {reason}",
        "RestoreTableSetMismatch": "backup and database hold different tables: {tables}",
        "SchemaFileMissing": "{path} is missing",
        "SetNullNeedsNullable": "{child}.{column} takes no null, so it cannot be set to null",
        "SharedFolderMissing": "spark.checkpoint.dir must name a folder that all machines of {master} share",
        "StorageFormatUnknown": "the store has features or a generation that this version does not know: {features}, {generation}",
        "StorageGenerationInvalid": "the store is of generation {now} and cannot be brought to {wanted}",
        "StorageReadOnly": "the store has features that a writer must know: {features}",
        "TableAlreadyExists": "table {table} exists already",
        "TableFileMissing": "files of {table} are missing; repair the database first",
        "TableNotFound": "there is no table {table}",
        "TypeMismatch": "column {column} of type {type} does not take {value}",
        "UniqueInUse": "relations rely on constraint {name} of {table}",
        "UniqueNotFound": "{table} has no constraint {name}",
        "UniqueViolation": "constraint {name} of {table} would be violated",
    }

    def message(self, code: str) -> str | None:
        return self.TEXTS.get(code)


class Russian:
    TEXTS = {
        "BackupArchiveExists": "{path} уже существует",
        "BackupChecksumMismatch": "контрольная сумма {member} не совпадает",
        "BackupDestinationInsideDb": "{path} лежит внутри базы",
        "BackupFormatUnknown": "копию вида {format} прочесть нельзя",
        "BackupNotFound": "в {path} нет резервной копии",
        "BackupSourceInvalid": "замечания к базе мешают резервной копии",
        "BackupVersionUnknown": "копию версии {version} прочесть нельзя",
        "BrokenRecordBlocksRewrite": "потеряются нечитаемые строки: {count}",
        "ColumnAlreadyExists": "в {table} уже есть столбец {column}",
        "ColumnInUse": "столбец {column} таблицы {table} занят: {by}",
        "ColumnNotFound": "в {table} нет столбца {column}",
        "DatabaseAlreadyExists": "в {path} уже есть база",
        "DatabaseNotFound": "в {path} нет базы",
        "DuplicateIndexName": "имя индекса {index} в {table} повторяется",
        "FkBackingIndexMissing": "нет индекса {child} под ограниченным столбцом {column}",
        "ForeignKeyRestricted": "{child}.{column} ещё ссылается на {table}",
        "ImportIdInvalid": "{value} не годится как id строки {table}",
        "ImportValuesInvalid": "значения {table}.{column} не того типа: {count}",
        "IndexNotFound": "в {table} нет индекса {index}",
        "InvalidBackingPolicy": "нет такого правила для индексов связей: {policy}",
        "InvalidBetween": "BETWEEN берёт пару значений, а не {value}",
        "InvalidBrokenRecordPolicy": "нет такого правила для битых записей: {policy}",
        "InvalidColumnType": "{type} не тип столбца",
        "InvalidIdentifier": "имя {name} недопустимо",
        "InvalidIn": "IN берёт список значений, а не {value}",
        "InvalidIndexFields": "поля индекса {index} таблицы {table} заданы неверно",
        "InvalidLikePattern": "LIKE берёт текст, а не {value}",
        "InvalidLimit": "limit не бывает отрицательным: {limit}",
        "InvalidOffset": "offset не бывает отрицательным: {offset}",
        "InvalidOperand": "{operator} не принимает {value}",
        "InvalidOperator": "неизвестный оператор {operator}",
        "InvalidRelation": "у связи {relation} неизвестный вид или действие",
        "InvalidSchemaFile": "схему {table} прочесть нельзя: {reason}",
        "InvalidSortDirection": "направление {direction} не asc и не desc",
        "InvalidTemporal": "{value} не {type} для столбца {column}",
        "InvalidUniqueConstraint": "ограничение {name} таблицы {table} задано неверно",
        "InvalidUtf8": "столбец {column} принимает только текст в UTF-8",
        "LikeOnInstantUnsupported": "LIKE не применяется к моментам вроде {column}",
        "LikeOnNonStringColumn": "LIKE нужен текстовый столбец, а не {column}",
        "LockLost": "блокировку {path} забрал другой писатель; ничего не записано",
        "LockTimeout": "блокировка записи {path} не снята вовремя",
        "ManifestUnreadable": "манифест {path} прочесть нельзя: {reason}",
        "MetaEntryMissing": "в манифесте нет годной записи о {table}",
        "MigrateColumnNoDefault": "строкам {table} нечего дать в столбец {column}",
        "MigrateColumnTypeChange": "столбец {column} таблицы {table} не меняет тип",
        "NonFiniteFloat": "столбец {column} принимает только конечные числа",
        "NullInColumn": "столбец {column} таблицы {table} не принимает null",
        "NumberOutOfRange": "{value} вне границ столбца {column}",
        "PkColumnNotRenamable": "id таблицы {table} не переименовать",
        "PrimaryIndexNotDroppable": "первичный индекс {table} не удалить",
        "PrimaryKeyInvalid": "первый столбец {table} должен быть id типа int",
        "QueryUnknownColumn": "в таблице {table} нет столбца {column}",
        "RecordClassInvalid": "{cls} не класс записей с id",
        "RecordClassMissing": "для {table} нет класса записей",
        "RecordColumnUnknown": "полю {field} класса {cls} не отвечает столбец: {column}",
        "RecordEnumValue": "{value} не вариант поля {field} класса {cls}",
        "RecordNull": "поле {field} класса {cls} не принимает null",
        "RecordTableMismatch": "{cls} не описывает строки {table}",
        "RecordTableTaken": "для {table} задан другой класс записей",
        "RecordTemporalValue": "{value} не момент времени для поля {field} класса {cls}",
        "RecordTypeMismatch": "поле {field} класса {cls} не подходит к типу {type}",
        "RelationColumnNotFound": "в {table} нет столбца {column} для связи",
        "RelationDuplicate": "связь {relation} уже объявлена",
        "RelationNotExecutable": "связь {relation} больше не подходит к таблицам",
        "RelationNotFound": "нет связи {relation}",
        "RelationReferencesNotUnique": "{table}.{column} должен быть уникальным",
        "RelationTableNotFound": "для связи нет таблицы {table}",
        "RelationTypeMismatch": "связь {relation} соединяет разные типы",
        "ReorderColumnsDuplicate": "столбец {table} назван дважды",
        "ReorderColumnsIncomplete": "порядок должен назвать все столбцы {table}",
        "ReorderColumnsUnknown": "в {table} нет столбцов {columns}",
        "RequiredColumnMissing": "столбцу {column} таблицы {table} нужно значение",
        "ReservedIndexName": "имена вроде {index} заняты движком в {table}",
        "RestoreFailed": "копию развернуть не удалось: {reason}",
        "RestoreTableSetMismatch": "таблицы копии и базы различаются: {tables}",
        "SchemaFileMissing": "нет файла {path}",
        "SetNullNeedsNullable": "{child}.{column} не принимает null",
        "SharedFolderMissing": "spark.checkpoint.dir должен назвать общую папку машин {master}",
        "StorageFormatUnknown": "неизвестные свойства или поколение хранилища: {features}, {generation}",
        "StorageGenerationInvalid": "хранилище поколения {now} не привести к {wanted}",
        "StorageReadOnly": "писать нельзя, неизвестны свойства: {features}",
        "TableAlreadyExists": "таблица {table} уже есть",
        "TableFileMissing": "нет файлов {table}; сначала почините базу",
        "TableNotFound": "нет таблицы {table}",
        "TypeMismatch": "столбец {column} типа {type} не принимает {value}",
        "UniqueInUse": "на ограничение {name} таблицы {table} опираются связи",
        "UniqueNotFound": "в {table} нет ограничения {name}",
        "UniqueViolation": "нарушено ограничение {name} таблицы {table}",
    }

    def message(self, code: str) -> str | None:
        return self.TEXTS.get(code)


class StoreError(Exception):
    """Base of all errors; `code` and `params` are stable, the text follows the locale."""

    locale: Locale = English()

    def __init__(self, code: str, **params):
        self.code, self.params = code, params
        text = self.locale.message(code) or English.TEXTS.get(code)
        try:
            text = text.format(**params) if text else f"{code} {params}"
        except KeyError:
            text = f"{code} {params}"
        super().__init__(text)

    @classmethod
    def set_locale(cls, locale: Locale) -> None:
        StoreError.locale = locale


class DataError(StoreError):
    """Values that a column does not take."""


class QueryError(StoreError):
    """Conditions, ordering and pagination."""


class SchemaError(StoreError):
    """Names, types, indexes and constraints of a schema."""


class TableError(StoreError):
    """Tables that are missing or in the way."""


class RelationError(StoreError):
    """Foreign keys."""


class MappingError(StoreError):
    """Record classes."""


class ServiceError(StoreError):
    """Integrity, backup and restore."""


class LockError(StoreError):
    """Writer locks."""


class IoError(StoreError):
    """Files of the store."""
