"""salesspark: sales analytics at order-line grain, expressed as Spark DataFrame plans.

Every public operator takes a DataFrame (usually the flattened sales view from
``salesspark.sources``) and returns a lazy DataFrame. Nothing data-sized is
collected to the driver.
"""

from salesspark.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
