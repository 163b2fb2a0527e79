"""A deployment's engine: settings, names, recognizers and the vault in one, built from a folder of control files.

Control files are read anew for every batch, so the mode, the recognizer's switch and the
profile can be changed while a stream runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import session
from ..plans.storage import filesystem
from ..sources import entities, vaults
from ..sources.profile import Profile
from . import guard, mask, ner


def control(spark: SparkSession, folder: str, name: str) -> str | None:
    """The text of a control file; none where it is missing."""
    path = f"{folder.rstrip('/')}/{name}"
    fs, place = filesystem(spark, path)
    if not fs.exists(place):
        return None
    first = spark.read.text(path, wholetext=True).first()
    return first.value if first else ""


def mode(spark: SparkSession, folder: str) -> str:
    return guard.mode_of(control(spark, folder, fixed.MODE_FILE))


@dataclass
class Engine:
    """Masks batches of messages and restores batches of replies against one vault table.

    vaults: the folder of the vault table; without one the vault is kept for the lifetime of
    this object alone.  agent: where given, all sessions share that one vault.
    """

    spark: SparkSession
    profile: Profile = field(default_factory=Profile)
    names: DataFrame | None = None
    secondary: Callable[[Column], Column] | None = None
    primary: Callable[[Column], Column] | None = None
    vaults: str | None = None
    agent: str | None = None
    book: DataFrame | None = None

    @staticmethod
    def of(spark: SparkSession, folder: str, agent: str | None = None) -> Engine:
        """From a folder of control files: profile, names, the service of a recognizer with its switch, and where the vault is kept."""
        settings = control(spark, folder, fixed.PROFILE_FILE)
        listed = control(spark, folder, fixed.NAMES_FILE)
        url = (control(spark, folder, fixed.NER_URL_FILE) or "").strip()
        switch = (control(spark, folder, fixed.NER_SWITCH_FILE) or "").strip().lower()
        where = (control(spark, folder, fixed.VAULT_MODE_FILE) or "").strip().lower()
        return Engine(
            spark,
            Profile() if settings is None else Profile.parse(settings),
            None if listed is None else entities.from_file(spark, f"{folder.rstrip('/')}/{fixed.NAMES_FILE}"),
            ner.recognizer(ner.service(url), url) if url and switch != fixed.NER_OFF else None,
            vaults=None if where == fixed.MEMORY_VAULT else f"{folder.rstrip('/')}/{fixed.VAULT_FOLDER}",
            agent=agent,
        )

    def known(self) -> DataFrame | None:
        """The vault as it is now."""
        return self.book if self.vaults is None else vaults.load(self.spark, self.vaults)

    def scoped(self, rows: DataFrame) -> DataFrame:
        """Rows with the key of their vault: the agent's, or that of their session."""
        key = session(F.col("vault_key")) if self.agent is None else F.lit(self.agent)
        return rows.withColumn("vault_key", key)

    def sanitize(self, messages: DataFrame, mode: str = "enforce") -> tuple[DataFrame, DataFrame | None, DataFrame]:
        """``messages`` with ``sent``, an audit line per vault, and the alerts that the profile wants.

        Masks, puts the instruction in front where the profile says so, and saves the vault if
        there are new values.  Rows that fail go out as they came, or not at all where the profile's fail mode is closed.
        """
        known = self.known()
        finding = {"names": self.names, "never": list(self.profile.never_mask), "secondary": self.secondary, "primary": self.primary}
        scoped = self.scoped(messages)
        sent, book, audit = guard.outbound(scoped, mode, known=known, instruction=mask.INSTRUCTION if self.profile.token_instruction else None, closed=self.profile.fail_mode == "closed", once=self.secondary is not None, **finding)
        if book is not None:
            self.book = book
            if self.vaults is not None:
                vaults.save(book, self.vaults, known)
        events = guard.outbound_alerts(sent)
        return sent.drop("error", "missed"), audit, events.where(F.col("kind").isin(*self.profile.alerts_on, "withheld"))

    def restore(self, replies: DataFrame, mode: str = "enforce", restorer: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """Replies with values put back, an audit line for each, and the alerts that the profile wants; see ``guard.inbound``."""
        book = self.known()
        if book is None:
            book = self.spark.createDataFrame([], "vault_key string, real string, token string, entity_type string, n int")
        return guard.inbound(self.scoped(replies), book, mode, restorer, wanted=(*self.profile.alerts_on, "restore_error"))


def live(spark: SparkSession, folder: str, agent: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """For ``DataFrame.transform`` and ``foreachBatch``: masks each batch by the control files as they are then."""
    memory = Engine.of(spark, folder, agent)

    def run(messages: DataFrame) -> DataFrame:
        engine = Engine.of(spark, folder, agent)
        engine.book = memory.book
        out = engine.sanitize(messages, mode(spark, folder))[0]
        memory.book = engine.book
        return out

    return run
