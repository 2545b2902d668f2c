"""All registered queries; importing this package fills the registry."""

from rillwork.catalogue import cleaning, features, modelling, spatial, storage, streams  # noqa: F401
from rillwork.catalogue.registry import ORACLES, QUERIES  # noqa: F401
